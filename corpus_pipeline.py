"""A training corpus from raw documents: five stages, each written out and read again.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All stages but
the last return the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import decontamination, near_duplicates, packing, private_data, quality
from lintlake.llm.queries import TOKENIZER
from lintlake.llm.tables import documents, labels, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (operator 6)."""
    return quality.keep_good(docs, labels(spark, sf_dir), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, similarity 0.8 or more (operator 5)."""
    return near_duplicates.one_of_each(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text (operator 1)."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (operator 10)."""
    return private_data.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens (operator 2)."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), packing.Capacity(tokens=2048))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Trained scores and a tokenizer decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
