"""The pipeline's stages, one after the other, on the smallest tables."""

import corpus_pipeline
from lintlake.llm import private_data, quality
from lintlake.llm.tables import documents, labels, stored

from ..conftest import SF


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs, counts = documents(spark, SF), []
    columns = docs.columns
    good = {r.doc_id for r in quality.classify(docs, labels(spark, SF)).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == columns
        counts.append(out.count())
        if name == "quality":
            assert {r.doc_id for r in out.collect()} == good
        if name == "personal_data":
            left = private_data.findings(out).agg({"n_email": "sum", "n_ip": "sum", "n_card": "sum", "n_phone": "sum"}).first()
            assert set(left) == {0}
        docs = out
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
