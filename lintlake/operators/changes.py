"""What changed between two listings of the same tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified and removed paths between two (project, path, mtime_ns) listings."""
    before = old.select("project", "path", F.col("mtime_ns").alias("old_ns"))
    after = new.select("project", "path", F.col("mtime_ns").alias("new_ns"))
    status = (
        F.when(F.col("old_ns").isNull(), F.lit("added"))
        .when(F.col("new_ns").isNull(), F.lit("removed"))
        .when(F.col("old_ns") != F.col("new_ns"), F.lit("modified"))
    )
    return (
        before.join(after, ["project", "path"], "full_outer")
        .select("project", "path", status.alias("status"))
        .where(F.col("status").isNotNull())
    )


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("project").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "removed")],
        F.count("*").alias("total"),
    )
