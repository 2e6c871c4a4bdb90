"""Saved state: score snapshots, test runs, listings, JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LINE_RULES, PROBE_CASES, SNAPSHOTS, TEST_RUNS


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Add one row per project. Spark's commit makes a failed write leave nothing."""
    snapshots.write.mode("append").json(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots, oldest first. Unreadable lines and rows without an id are skipped."""
    return (
        spark.read.schema(SNAPSHOTS)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .where(F.col("id").isNotNull())
        .orderBy("project", "id")
    )


def save_run(outcomes: DataFrame, run_id: str, path: str) -> None:
    """Save the outcomes of one run as a partition of its own; run ids sort in time order.

    A run counts once its projects are named below ``commits``, which happens after its rows are in place, so
    a run that broke off is not seen. Saving a run again replaces it.
    """
    columns = [c.split()[0] for c in TEST_RUNS.split(", ") if not c.startswith("run_id ")]
    spark, rows = outcomes.sparkSession, f"{path}/rows/run_id={run_id}"
    outcomes.select(*columns).write.mode("overwrite").parquet(rows)
    projects = spark.read.schema(TEST_RUNS).parquet(rows).select("project").distinct()
    projects.write.mode("overwrite").parquet(f"{path}/commits/run_id={run_id}")


def saved_run(spark: SparkSession, run_id: str, path: str) -> DataFrame:
    """The outcomes of one saved run."""
    return spark.read.schema(TEST_RUNS).parquet(f"{path}/rows/run_id={run_id}").drop("run_id")


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of the latest committed run of each project.

    The commits tell the newest run of each project; of the rows, only partitions from the oldest of these on are read.
    """
    commits = spark.read.schema("project STRING, run_id STRING").parquet(f"{path}/commits")
    newest = commits.groupBy("project").agg(F.max("run_id").alias("run_id"))
    rows = spark.read.schema(TEST_RUNS).parquet(f"{path}/rows")
    recent = rows.where(F.col("run_id") >= newest.agg(F.min("run_id").alias("oldest")).scalar())
    return recent.join(newest, ["project", "run_id"], "left_semi")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_line_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE_RULES).json(path)


def read_probe_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE_CASES).json(path)
