"""Splits for small inputs, and expressions that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a table that arrives in fewer pieces than there are cores.

    A table of many files keeps its own splits and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that later filters and projections will not compute again.

    The optimizer copies an expression into each place that uses it; it does not look
    into a generator.
    """
    return df.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
