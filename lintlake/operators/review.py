"""Review of added lines, and the combined gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.codelines import unguarded_update
from ..schemas import FINDING_COLUMNS
from ..sources.corpus import language_of
from .scoring import is_blocking

LINE_KEY = ["project", "path", "line_no"]


def race_findings(added: DataFrame) -> DataFrame:
    """Unguarded updates of shared state on added lines. No shuffle."""
    title, category, _ = V.RULES["race-condition"]
    return (
        added.where(F.contains("text", F.lit("=")))
        .select("project", "path", "line_no", unguarded_update(F.col("text")).alias("name"))
        .where(F.col("name").isNotNull())
        .select(
            "project",
            F.lit("race-condition").alias("rule"),
            F.lit(title).alias("title"),
            F.lit(category).alias("category"),
            F.lit("WARNING").alias("severity"),
            "path",
            "line_no",
            F.concat(F.lit("`"), "name", F.lit("`" + V.RACE_MESSAGE)).alias("message"),
            F.when(language_of(F.col("path")) == "Rust", F.lit(V.RACE_FIX_RUST))
            .otherwise(F.lit(V.RACE_FIX_OTHER))
            .alias("suggestion"),
        )
        .select(*FINDING_COLUMNS)
    )


def touched_files(files: DataFrame, added: DataFrame) -> DataFrame:
    """Files that a diff added lines to, for scanning only those.

    Worth it where diffs touch a small part of the corpus; otherwise the join moves
    file contents and it is cheaper to scan everything.
    """
    return files.join(added.select("project", "path").distinct(), ["project", "path"], "left_semi")


def review_findings(findings: DataFrame, files: DataFrame, added: DataFrame) -> DataFrame:
    """Scan findings that land on added lines, plus race findings on those lines.

    Only findings are joined, never file contents. Whole-file findings (line 0) are
    not on a line and drop out; added lines of files that are gone are ignored.
    """
    on_added = (
        findings.where("line_no > 0")
        .join(added.select(*LINE_KEY), LINE_KEY, "left_semi")
        .select(*FINDING_COLUMNS)
    )
    present = added.join(files.select("project", "path"), ["project", "path"], "left_semi")
    return on_added.unionByName(race_findings(present))


def review_summary(added: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings, blocking findings and verdict for every project with added lines."""
    stacked = added.select("project", F.lit(None).cast("string").alias("severity")).unionByName(
        findings.select("project", "severity")
    )
    verdict = (
        F.when(F.col("blocking") > 0, F.lit("failed"))
        .when(F.col("findings") == 0, F.lit("passed"))
        .otherwise(F.lit("passed with advisories"))
    )
    return (
        stacked.groupBy("project")
        .agg(
            F.count("severity").alias("findings"),
            F.count_if(is_blocking(F.col("severity"))).alias("blocking"),
        )
        .withColumn("verdict", verdict)
    )


def gate(rows: DataFrame, user_findings: DataFrame, added: DataFrame) -> DataFrame:
    """Pass or fail per project: no blocking scan finding, no user-rule finding at all,
    no blocking review finding.

    Takes ``scan_rows``: its file rows name the projects, and its blocking findings are
    marked where they lie on added lines, so the corpus is scanned once for both. Race
    findings are warnings and never block. One aggregate reduces everything.
    """
    on_line = added.select(*LINE_KEY).distinct().withColumn("on_added", F.lit(True))
    blocking = is_blocking(F.col("severity"))
    marked = rows.where(F.col("severity").isNull() | blocking).join(on_line, LINE_KEY, "left")
    blocks = F.coalesce(blocking, F.lit(False))
    stacked = marked.select(
        "project",
        blocks.cast("int").alias("scan"),
        F.lit(0).alias("rules"),
        (blocks & F.col("on_added").isNotNull()).cast("int").alias("review"),
    ).unionByName(
        user_findings.select(
            "project", F.lit(0).alias("scan"), F.lit(1).alias("rules"), F.lit(0).alias("review")
        )
    )
    return (
        stacked.groupBy("project")
        .agg(
            F.sum("scan").alias("scan_blocking"),
            F.sum("rules").alias("rule_findings"),
            F.sum("review").alias("review_blocking"),
        )
        .withColumn(
            "passed",
            (F.col("scan_blocking") == 0)
            & (F.col("rule_findings") == 0)
            & (F.col("review_blocking") == 0),
        )
    )
