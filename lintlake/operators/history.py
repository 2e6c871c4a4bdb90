"""Score history: snapshots, project index, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import score_band, spark_glyph


def snapshot_id(nanos: Column) -> Column:
    """Zero-padded 20-digit id, so that text order is time order."""
    return F.lpad(nanos.cast("string"), 20, "0")


def make_snapshots(scores: DataFrame, nanos: Column, label: str | None = None) -> DataFrame:
    """One snapshot per project from ``project_scores`` rows."""
    return scores.select(
        "project",
        snapshot_id(nanos).alias("id"),
        F.concat(F.lit("epoch-"), F.floor(nanos / 1_000_000_000).cast("string")).alias("timestamp"),
        F.lit(label).cast("string").alias("label"),
        F.col("security_score").cast("int").alias("security_score"),
        *[
            F.col(c).cast("bigint").alias(c)
            for c in (
                "total_findings", "critical", "high", "warning", "info", "files", "lines_of_code"
            )
        ],
    )


def history_points(snapshots: DataFrame) -> DataFrame:
    """Every snapshot with its band and trend glyph.

    Points stay rows: a project may have any number of them, and the glyph of one
    does not depend on the others.
    """
    score = F.col("security_score")
    return snapshots.select(
        "project", "id", "security_score", score_band(score).alias("band"), spark_glyph(score).alias("glyph")
    )


def project_index(snapshots: DataFrame) -> DataFrame:
    """Created, last update, latest and best score, and count per project."""
    return snapshots.groupBy("project").agg(
        F.min_by("timestamp", "id").alias("created"),
        F.max_by("timestamp", "id").alias("last_updated"),
        F.max_by("security_score", "id").alias("latest_score"),
        F.max("security_score").alias("best_score"),
        F.count("*").alias("snapshot_count"),
    )


def score_trend(snapshots: DataFrame) -> DataFrame:
    """First against latest snapshot, for projects with at least two.

    ``first`` and ``latest`` are whole snapshots; fixed and added findings never go
    below zero.
    """
    whole = F.struct(*[c for c in snapshots.columns if c != "project"])
    ends = (
        snapshots.groupBy("project")
        .agg(
            F.min_by(whole, "id").alias("first"),
            F.max_by(whole, "id").alias("latest"),
            F.count("*").alias("snapshot_count"),
        )
        .where("snapshot_count >= 2")
    )
    fewer = F.col("first.total_findings") - F.col("latest.total_findings")
    return ends.select(
        "project",
        "first",
        "latest",
        (F.col("latest.security_score") - F.col("first.security_score")).alias("score_change"),
        F.greatest(fewer, F.lit(0)).alias("findings_fixed"),
        F.greatest(-fewer, F.lit(0)).alias("findings_added"),
        "snapshot_count",
    )
