"""Plans keep their shape: shuffles, pruning, and rank limits before the shuffle."""

from lintlake.operators import dependencies as DE
from lintlake.operators import duplicates as DU
from lintlake.operators import graph as GR
from lintlake.operators import rules as RU
from lintlake.operators import scoring as SC
from lintlake.plans import derived as D
from lintlake.plans.sizing import spread

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    from pyspark.sql import functions as F

    from lintlake.sources.corpus import corpus_from_table

    table = D.table(spark, SF, "documents")
    return corpus_from_table(table, F.col("source"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text"))


def test_line_rules_do_not_shuffle(spark):
    assert "Exchange" not in plan(RU.line_findings(docs(spark)))


def test_imports_do_not_shuffle(spark):
    assert "Exchange" not in plan(DE.import_edges(docs(spark)))


def test_duplicates_do_not_shuffle(spark):
    text = plan(DU.duplicate_blocks(docs(spark)))
    assert "Exchange" not in text and "EvalPython" not in text


def test_the_whole_scan_is_one_pass(spark):
    text = plan(SC.project_scores(RU.scan_rows(docs(spark))))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "EvalPython" not in text


def test_scores_shuffle_only_counts(spark):
    files = docs(spark)
    text = plan(SC.project_scores(RU.scan_rows(files)))
    assert text.count("Exchange") == 1 and "partial_count_if" in text.replace("partial_count(if", "partial_count_if")


def test_scan_reads_only_its_columns(spark):
    schema = plan(RU.line_findings(docs(spark))).split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<doc_id:bigint,text:string,source:string>"


def test_top_lists_are_cut_before_the_shuffle(spark):
    files = docs(spark)
    for df in (SC.top_findings(RU.line_findings(files), 3), GR.import_hotspots(files), GR.top_modules(DE.import_edges(files))):
        assert "WindowGroupLimit" in plan(df)


def test_sizes(spark):
    assert spread(spark.range(0, 100, 1, 2), "id").rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide


def test_responses_are_judged_by_aggregates(spark):
    """No window over a case's responses; each aggregate starts before its shuffle."""
    from lintlake.operators import probes as PR
    from lintlake.operators import responses as RE

    plans = PR.request_plan(PR.expand_cases(D.probe_cases(spark, SF)))
    text = plan(RE.judge_cases(plans, D.recorded_responses(spark, SF)))
    assert "Window" not in text and text.count("partial_max_by") == 1 and text.count("partial_min") >= 1


def test_each_response_is_shuffled_and_joined_once(spark):
    """Where a case stops needs no plan, and expectations are tested on the deciding response only."""
    from lintlake.operators import probes as PR
    from lintlake.operators import responses as RE

    plans = PR.request_plan(PR.expand_cases(D.probe_cases(spark, SF)))
    text = plan(RE.judge_cases(plans, D.recorded_responses(spark, SF)))
    assert text.count("Join ") == 3
    assert all("lambda" not in line for line in text.splitlines() if "partial_max_by" in line)


def test_weaknesses_judge_mapped_issues_only(spark):
    """Cases of an issue that no weakness maps to stay out before their responses are judged; the counts stay."""
    from lintlake.operators import compliance as CO
    from lintlake.operators import probes as PR
    from lintlake.operators import responses as RE

    plans, responses = PR.request_plan(PR.expand_cases(D.probe_cases(spark, SF))), D.recorded_responses(spark, SF)
    none = spark.createDataFrame([], "project STRING, rule STRING")
    mapped = plans.where(CO.has_mapped_issue())
    assert 0 < mapped.count() < plans.count()
    counts = [sorted(map(tuple, CO.weakness_counts(CO.finding_keys(none, RE.judge_cases(p, responses))).collect())) for p in (plans, mapped)]
    assert counts[0] == counts[1] and counts[0]


def test_package_use_is_one_join_on_keys(spark):
    """One read of the corpus and one join, and rows without a use of their own meet no hot key."""
    files = docs(spark)
    declared = spark.createDataFrame([("p", "pom.xml", "pom.xml", "Java (Maven)", f"n{i % 3}", "1", False) for i in range(50)],
                                     "project STRING, path STRING, manifest STRING, ecosystem STRING, name STRING, version STRING, dev BOOLEAN")
    for out in (DE.dependency_inventory(files, declared=declared), GR.dependency_nodes(files, declared=declared)):
        text = plan(out)
        assert text.count("FileScan") == 1 and text.count("Join ") == 1
    usage = DE.usage_index(files)
    from pyspark.sql import functions as F

    numbered = declared.withColumn("path", F.monotonically_increasing_id().cast("string"))
    assert DE.with_usage(numbered, usage, F.lit(False)).where("files > 0").count() == 0


def test_only_recent_runs_are_read(spark, tmp_path):
    from lintlake.schemas import TEST_RUNS
    from lintlake.sources import state as ST

    path = str(tmp_path / "runs")
    row = lambda project, verdict: (project, "", "c", None, "n", "HIGH", "t", verdict, None, None, None)
    for run_id, rows in (("01", [row("a", "x"), row("b", "x")]), ("02", [row("a", "y"), row("b", "y")]), ("03", [row("a", "z")])):
        ST.save_run(spark.createDataFrame(rows, TEST_RUNS), run_id, path)
    # a run whose rows are there but whose commit is not
    spark.createDataFrame([row("b", "half")], TEST_RUNS).drop("run_id").write.parquet(f"{path}/rows/run_id=04")
    df = ST.latest_run(spark, path)
    assert {(r.project, r.run_id, r.verdict) for r in df.collect()} == {("a", "03", "z"), ("b", "02", "y")}
    assert "PartitionFilters: [isnotnull(run_id" in plan(df)
    ST.save_run(spark.createDataFrame([row("b", "again")], TEST_RUNS), "02", path)
    assert ("b", "02", "again") in {(r.project, r.run_id, r.verdict) for r in ST.latest_run(spark, path).collect()}
