"""Summaries of a test run: totals, risk, executive and technical views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.display import risk_band


def explanation_table(spark) -> DataFrame:
    return spark.createDataFrame(
        V.EXPLANATIONS,
        "id STRING, title STRING, summary STRING, impact STRING, remediation STRING, "
        "references ARRAY<STRING>",
    )


def explain(issues: DataFrame, column: str = "issue_id") -> DataFrame:
    """Attach the explanation of an issue id, trimmed and in any case.

    The explanations are a fixed list of five, so they may go to every task.
    """
    known = explanation_table(issues.sparkSession).withColumn("lookup", F.upper("id")).drop("id")
    return issues.withColumn("lookup", F.upper(F.trim(F.col(column)))).join(
        F.broadcast(known), "lookup", "left"
    ).drop("lookup")


def _verdict_counts():
    verdict = F.col("verdict")
    return [
        F.count("*").alias("tested"),
        F.count_if(verdict == "secure").alias("passed"),
        F.count_if(verdict == "vulnerable").alias("vulnerable"),
        F.count_if(verdict == "errored").alias("errored"),
    ]


def suite_totals(outcomes: DataFrame) -> DataFrame:
    """Verdict counts per suite; cases outside any suite count as one suite."""
    return outcomes.groupBy(
        "project", F.coalesce("suite", F.lit(V.DEFAULT_SUITE)).alias("suite")
    ).agg(*_verdict_counts())


def run_totals(outcomes: DataFrame) -> DataFrame:
    """Verdict counts and the distinct issue ids of vulnerable outcomes (five at most)."""
    issue = F.when(F.col("verdict") == "vulnerable", F.col("issue_id"))
    return outcomes.groupBy("project").agg(
        *_verdict_counts(), F.sort_array(F.collect_set(issue)).alias("issue_ids")
    )


def executive_summary(outcomes: DataFrame, latest_scores: DataFrame | None = None) -> DataFrame:
    """Score, risk, coverage, issue ids and their remediations per project.

    Both sides are one row per project before they meet. The vulnerable cases
    themselves are rows of ``technical_evidence``.
    """
    totals = run_totals(outcomes)
    if latest_scores is None:
        joined = totals.withColumn("security_score", F.lit(None).cast("int"))
    else:
        joined = totals.join(latest_scores.select("project", "security_score"), "project", "left")
    fixes = F.create_map(*[F.lit(x) for e in V.EXPLANATIONS for x in (e[0], e[4])])
    return joined.select(
        "project",
        "security_score",
        risk_band(F.col("vulnerable"), F.col("errored"), F.col("security_score")).alias("risk"),
        "tested",
        "passed",
        "vulnerable",
        "errored",
        "issue_ids",
        F.array_compact(F.transform("issue_ids", lambda i: F.element_at(fixes, i))).alias("remediations"),
    )


def technical_evidence(outcomes: DataFrame) -> DataFrame:
    """Failed checks of vulnerable outcomes with remediation and first reference."""
    failed = F.filter("checks", lambda c: c["evaluated"] & ~c["passed"])
    rows = (
        outcomes.where(F.col("verdict") == "vulnerable")
        .withColumn("failed", failed)
        .drop("checks")
        .select("*", F.inline("failed"))
    )
    return explain(rows).select(
        "project",
        "case_id",
        "name",
        "severity",
        "target",
        "issue_id",
        "description",
        "detail",
        "remediation",
        F.get("references", F.lit(0)).alias("reference"),
    )
