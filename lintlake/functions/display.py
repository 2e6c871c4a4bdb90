"""Presentation values: score bands, trend glyphs, safe truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import literal_array


def score_band(score: Column) -> Column:
    return (
        F.when(score >= V.GOOD_SCORE, F.lit("good"))
        .when(score >= V.FAIR_SCORE, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def spark_glyph(score: Column) -> Column:
    """One of eight bar heights for a 0-100 score."""
    level = F.floor(F.least(score, F.lit(100)) * (len(V.SPARK_GLYPHS) - 1) / 100)
    return F.element_at(literal_array(V.SPARK_GLYPHS), (level + 1).cast("int"))


def bar_width(n: Column, largest: Column) -> Column:
    """Width of a summary bar: at least 1 for a non-zero count."""
    width = F.floor(n * V.BAR_WIDTH / F.greatest(largest, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(width, F.lit(1))).cast("int")


def safe_value(value: Column) -> Column:
    """Shortened, printable form of an input value."""
    masked = F.regexp_replace(value, r"\p{Cc}", V.CONTROL_MASK)
    long = F.concat(
        F.left(masked, F.lit(V.DISPLAY_CHARS)), F.lit("… ("), F.length(value).cast("string"), F.lit(" chars)")
    )
    return (
        F.when(F.length(masked) > V.DISPLAY_CHARS, long)
        .when(masked == "", F.lit("(empty)"))
        .otherwise(masked)
    )


def risk_band(vulnerable: Column, errored: Column, score: Column) -> Column:
    """HIGH / MEDIUM / LOW from a run's counts and an optional (NULL) score."""
    return (
        F.when((vulnerable > 0) | F.coalesce(score < V.FAIR_SCORE, F.lit(False)), F.lit("HIGH"))
        .when(F.coalesce(score < V.GOOD_SCORE, F.lit(False)) | (errored > 0), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
