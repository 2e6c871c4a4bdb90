"""A replay-safe table sink: one folder per batch, rewritten if the batch is retried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None
) -> StreamingQuery:
    """Write a stream's batches below ``path``; without an interval, take what is there and stop."""
    return _start(
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: write_batch(df, path, n)),
        checkpoint,
        interval,
    )


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_each_batch(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    return _start(stream.writeStream.outputMode(mode).foreachBatch(step), checkpoint, interval)


def newest_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """Latest version of each key of a table written in update mode."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")
