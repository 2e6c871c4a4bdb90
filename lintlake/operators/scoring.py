"""Per-project roll-ups of findings: counts, score, blocking flag, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.display import bar_width


def _pick(c: Column, pairs) -> Column:
    chain = None
    for key, value in pairs:
        chain = F.when(c == key, F.lit(value)) if chain is None else chain.when(c == key, F.lit(value))
    return chain


def severity_rank(severity: Column) -> Column:
    return _pick(severity, [(s, rank) for s, rank, _ in V.SEVERITIES])


def severity_weight(severity: Column) -> Column:
    return _pick(severity, [(s, weight) for s, _, weight in V.SEVERITIES])


def severity_of_word(word: Column) -> Column:
    """Severity label for a word in a rule or case; NULL for an unknown word."""
    return _pick(F.lower(word), V.SEVERITY_WORDS.items())


def rule_rank(rule: Column) -> Column:
    """Built-in rules in their order; registered rules come after them."""
    return F.coalesce(_pick(rule, [(r, i) for i, r in enumerate(V.RULES)]), F.lit(len(V.RULES)))


def is_blocking(severity: Column) -> Column:
    return severity.isin("CRITICAL", "HIGH")


def severity_counts(findings: DataFrame, by: list[str] = ["project"]) -> DataFrame:
    counts = [
        F.count_if(F.col("severity") == s).alias(s.lower()) for s, _, _ in V.SEVERITIES
    ]
    return findings.groupBy(*by).agg(*counts, F.count("*").alias("total_findings"))


def project_scores(rows: DataFrame, sign: Column | None = None) -> DataFrame:
    """Counts, 0-100 score, blocking flag and corpus size for every project.

    Takes ``scan_rows``, so a project without findings keeps its row (score 100) and the
    corpus is read once. A project that holds most rows is reduced before the shuffle. With ``sign`` the rows
    are differences between scans, each added or taken back.
    """
    severity = F.col("severity")

    def count(condition: Column) -> Column:
        if sign is None:
            return F.count_if(condition)
        return F.coalesce(F.sum(F.when(condition, sign)), F.lit(0)).cast("bigint")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value if sign is None else value * sign), F.lit(0))

    return (
        rows.groupBy("project")
        .agg(
            count(F.col("lines").isNotNull()).alias("files"),
            total(F.col("lines")).cast("bigint").alias("lines_of_code"),
            *[count(severity == s).alias(s.lower()) for s, _, _ in V.SEVERITIES],
            count(severity.isNotNull()).alias("total_findings"),
            total(severity_weight(severity)).alias("deduction"),
        )
        .withColumn("security_score", F.greatest(F.lit(0), 100 - F.col("deduction")).cast("int"))
        .withColumn("blocking", (F.col("critical") + F.col("high")) > 0)
        .drop("deduction")
    )


def with_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``scan_rows`` from saved findings and the files they came from."""
    file_rows = files.select("project", "path", "lines")
    return findings.unionByName(file_rows, allowMissingColumns=True)


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per project and category."""
    return findings.groupBy("project", "category").agg(F.count("*").alias("n"))


def severity_bars(findings: DataFrame) -> DataFrame:
    """Count and bar width per severity; the widest bar is the largest count."""
    counts = severity_counts(findings)
    labels = [s for s, _, _ in V.SEVERITIES]
    largest = F.greatest(*[F.col(s.lower()) for s in labels])
    bars = F.array(
        *[
            F.struct(
                F.lit(s).alias("severity"),
                F.col(s.lower()).alias("n"),
                bar_width(F.col(s.lower()), largest).alias("width"),
            )
            for s in labels
        ]
    )
    return counts.select("project", F.inline(bars))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Report order: severity, path, line, then rule. A range-partitioned sort."""
    return findings.orderBy(
        "project", severity_rank(F.col("severity")), "path", "line_no", rule_rank(F.col("rule")), "rule"
    )


def top_findings(findings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` findings per project in report order.

    A rank filter lets Spark cut each task's rows before the shuffle.
    """
    order = Window.partitionBy("project").orderBy(
        severity_rank(F.col("severity")), "path", "line_no", rule_rank(F.col("rule")), "rule", "message"
    )
    return findings.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= limit
    )
