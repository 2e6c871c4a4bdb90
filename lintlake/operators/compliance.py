"""Findings against a framework: category status and weakness counts.

Mappings and categories are plain Python lists, so a caller extends coverage by
passing longer lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V

Mapping = tuple[str, str, str, str]


def has_mapped_issue(mappings: Sequence[Mapping] = V.FRAMEWORK_MAPPINGS) -> Column:
    """Whether a planned case can count as a weakness; the others need not be judged for that."""
    return F.col("issue_id").isin([m[0] for m in mappings])


def finding_keys(findings: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Rule ids of findings, plus issue ids of vulnerable outcomes. Repeats are kept.

    With ``scan_rows`` the file rows come along as NULL keys, which name their project.
    """
    keys = findings.select("project", F.col("rule").alias("key"))
    if outcomes is None:
        return keys
    confirmed = outcomes.where((F.col("verdict") == "vulnerable") & F.col("issue_id").isNotNull())
    return keys.unionByName(confirmed.select("project", F.col("issue_id").alias("key")))


def category_status(
    keys: DataFrame,
    mappings: Sequence[Mapping] = V.FRAMEWORK_MAPPINGS,
    categories: Sequence[tuple[str, str]] = V.FRAMEWORK_CATEGORIES,
) -> DataFrame:
    """Every category of every project in ``keys``, with its status and ordered reasons.

    Warning where a mapped key is present, Passed where some mapping covers the
    category, else Not assessed, which is never a pass. A NULL key only names a project.
    One aggregate keeps the set of mapped keys seen, which is as small as the mapping.
    """
    mapped = F.when(F.col("key").isin([m[0] for m in mappings]), F.col("key"))
    present = keys.groupBy("project").agg(F.collect_set(mapped).alias("present"))

    def entry(ord_, category, title):
        own = [m for m in mappings if m[1] == category]
        reasons = [
            F.when(F.array_contains("present", key), F.lit(f"{cwe_title} ({key})"))
            for key, _, _, cwe_title in own
        ]
        found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
        return F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(category).alias("id"),
            F.lit(title).alias("title"),
            F.when(F.size(found) > 0, F.lit("Warning"))
            .otherwise(F.lit("Passed" if own else "Not assessed"))
            .alias("status"),
            found.alias("reasons"),
        )

    rows = F.array(*[entry(i, c, t) for i, (c, t) in enumerate(categories)])
    return present.select("project", F.inline(rows))


def weakness_counts(
    keys: DataFrame, mappings: Sequence[Mapping] = V.FRAMEWORK_MAPPINGS
) -> DataFrame:
    """Occurrences per weakness; every repeat of a key counts, the first mapping wins."""
    first: dict[str, Mapping] = {}
    for m in mappings:
        first.setdefault(m[0], m)
    key = F.col("key")
    weakness = None
    for name, _, cwe, title in first.values():
        pair = F.struct(F.lit(cwe).alias("cwe"), F.lit(title).alias("cwe_title"))
        weakness = (
            F.when(key == name, pair) if weakness is None else weakness.when(key == name, pair)
        )
    return (
        keys.where(key.isin(list(first)))
        .select("project", weakness.alias("w"))
        .groupBy("project", F.col("w.cwe").alias("cwe"), F.col("w.cwe_title").alias("cwe_title"))
        .agg(F.count("*").alias("n"))
    )
