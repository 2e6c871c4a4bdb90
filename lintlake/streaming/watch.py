"""Repeat the scan as files arrive, and find what changed between listings.

A scan of arriving files goes through three steps, each a stream of its own with its own checkpoint: the batch's files
are scanned with the configuration of the moment; per path, the state of the newest scan turns that into
differences; per project, the differences add up to the score. No step reads what an earlier batch has written but
for its own state of the keys, or buckets of paths, that are in the batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as V
from ..operators.changes import listing_changes
from ..operators.history import make_snapshots
from ..operators.rules import ScanConfig, scan_rows
from ..operators.scoring import project_scores
from ..schemas import FINDING_COLUMNS, FINDINGS
from ..sources.corpus import corpus_from_binary
from .sinks import run_each_batch, run_to_table, write_batch

#: Rows of a scan as they are handed on: findings, and a row without a rule for each file.
SCANNED = f"{FINDINGS}, lines INT"
#: The same rows with 1 where a scan added them and -1 where it took them back.
CHANGES = f"{SCANNED}, sign INT"
_PACKED = "project STRING, path STRING, row STRING"
#: The paths of a bucket: whose they are, the newest scan of each, and that scan's rows in order, one a line.
_STATE = "project ARRAY<STRING>, path ARRAY<STRING>, batch_id ARRAY<BIGINT>, rows ARRAY<STRING>"
#: Groups of paths by hash that have a state in common: some two hundred paths each at three million.
BUCKETS = 1 << 14


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


_HELD = ", ".join(part for part in SCANNED.split(", ") if part.split()[0] not in ("project", "path"))
_HELD_COLUMNS = _names(_HELD)


def stream_corpus(
    spark: SparkSession, root: str, project: str | None = None, ignore: Sequence[str] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """``files`` as they appear below a folder. A path is read once; rewritten files have to arrive under another folder."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return corpus_from_binary(raw, root, project, ignore, max_file_bytes)


def bucket_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows that the newest scans of a bucket's paths add to the ones before, and those they take back.

    The state is, for each path of the bucket, the newest scan's rows: as many as the file has findings, and one for
    the file. Of several scans of a path that arrive together the newest counts, and a scan that arrives again changes
    nothing.
    """
    came: dict[tuple, tuple[int, list[str]]] = {}
    for frame in frames:
        for project, path, batch_id, row in zip(*(frame[c].tolist() for c in ("project", "path", "batch_id", "row")), strict=True):
            newest, rows = came.get((project, path), (batch_id, None))
            if rows is None or batch_id > newest:
                came[project, path] = (batch_id, [row])
            elif batch_id == newest:
                rows.append(row)
    held = {(project, path): (batch_id, rows) for project, path, batch_id, rows in zip(*state.get, strict=True)} if state.exists else {}
    changes = []
    for of, (batch_id, rows) in came.items():
        before_id, before = held.get(of, (batch_id, ""))
        now = "\n".join(sorted(rows))  # JSON has no line breaks of its own
        if before_id > batch_id:
            continue
        held[of] = (batch_id, now)
        if before != now:
            old, new = Counter(before.split("\n") if before else ()), Counter(rows)
            changes += [(*of, row, -1) for row in (old - new).elements()] + [(*of, row, 1) for row in (new - old).elements()]
    state.update(tuple(zip(*((*of, *scan) for of, scan in held.items()), strict=True)))
    if changes:
        yield pd.DataFrame(changes, columns=["project", "path", "row", "sign"])


def _folder(spark: SparkSession, path: str, schema: str) -> str:
    """The folder, with an empty first batch so that a stream can start on it."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_id=-1")
    return path


def packed(rows: DataFrame) -> DataFrame:
    """project, path and the other columns of scanned rows as one text, which the keyed state compares."""
    return rows.select("project", "path", F.to_json(F.struct(*_HELD_COLUMNS)).alias("row"))


def scan_changes(spark: SparkSession, scans: str, buckets: int = BUCKETS) -> DataFrame:
    """The differences that the packed scans below a folder make, as a stream of CHANGES rows.

    A call of the state function costs far more than a row, so paths share their state with those of the same hash, in at
    most ``buckets`` calls a batch. A batch reads and rewrites the state of its buckets. The number must
    stay the same for the life of a checkpoint.
    """
    rows = spark.readStream.schema(f"{_PACKED}, batch_id BIGINT").parquet(scans)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("project", "path"), F.lit(buckets)))
    changes = bucketed.groupBy("bucket").applyInPandasWithState(
        bucket_changes, f"{_PACKED}, sign INT", _STATE, "update", GroupStateTimeout.NoTimeout
    )
    unpacked = changes.withColumn("row", F.from_json("row", _HELD))
    columns = {c: F.col(c) if c in ("project", "path", "sign") else F.col(f"row.{c}") for c in _names(CHANGES)}
    return unpacked.select(*(column.alias(c) for c, column in columns.items()))


class Watch:
    """The streams of a watched corpus, ended together."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self) -> None:
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def scan_stream(
    files: DataFrame,
    out: str,
    checkpoint: str,
    load_config: Callable[[], ScanConfig] = ScanConfig,
    clock_ns: Callable[[], int] | None = None,
    interval: str | None = None,
) -> Watch:
    """Scan each batch of new files into ``out``/scans and its differences into ``out``/changes.

    The configuration is loaded again for every batch. With a clock, each batch of differences also
    adds a score snapshot of all projects as they then stand. Without an interval, the streams take what is
    there one after the other and stop; with one they run side by side.
    """
    spark = files.sparkSession

    def scan(batch: DataFrame, batch_id: int) -> None:
        write_batch(packed(scan_rows(batch, load_config())), f"{out}/scans", batch_id)

    def snapshot(totals: DataFrame, batch_id: int) -> None:
        at = F.lit(clock_ns()).cast("decimal(20,0)")
        write_batch(make_snapshots(totals, at), f"{out}/snapshots", batch_id)

    queries: list[StreamingQuery] = []

    def run(query: StreamingQuery) -> None:
        queries.append(query)
        if interval is None:
            query.awaitTermination()

    scans, changes = _folder(spark, f"{out}/scans", _PACKED), _folder(spark, f"{out}/changes", CHANGES)
    run(run_each_batch(files, scan, f"{checkpoint}/scans", interval))
    run(run_to_table(scan_changes(spark, scans), changes, f"{checkpoint}/changes", "update", interval))
    if clock_ns is not None:
        totals = project_scores(read_changes(spark, out), F.col("sign"))
        run(run_each_batch(totals, snapshot, f"{checkpoint}/snapshots", interval, mode="complete"))
    return Watch(queries)


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """The differences as a stream of their own."""
    return spark.readStream.schema(f"{CHANGES}, batch_id BIGINT").parquet(f"{out}/changes").drop("batch_id")


def _current(spark: SparkSession, out: str) -> DataFrame:
    """What all differences add up to: the rows of the newest scan of each path."""
    columns = _names(SCANNED)
    rows = spark.read.schema(f"{CHANGES}, batch_id BIGINT").parquet(f"{out}/changes")
    left = rows.groupBy(*columns).agg(F.sum("sign").cast("int").alias("n")).where("n > 0")
    return left.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one")).drop("one")


def current_files(spark: SparkSession, out: str) -> DataFrame:
    """project, path and lines of the newest scan of each path."""
    return _current(spark, out).where("rule IS NULL").select("project", "path", "lines")


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the newest scan of each path."""
    return _current(spark, out).where("rule IS NOT NULL").select(*FINDING_COLUMNS)


def live_scores(findings: DataFrame, weight: Column, sign: Column | None = None) -> DataFrame:
    """Running findings, deduction and score per project over a stream of ``scan_rows``.

    A row without a severity stands for a file and keeps a clean project in the table. With ``sign`` the
    rows are differences, so a rewritten file takes back what it had added.
    """
    one = F.lit(1) if sign is None else sign
    total = F.coalesce(F.sum(weight * one), F.lit(0))
    found = F.coalesce(F.sum(F.when(F.col("severity").isNotNull(), one)), F.lit(0))
    return (
        findings.groupBy("project")
        .agg(found.cast("bigint").alias("total_findings"), total.alias("deduction"))
        .withColumn("security_score", F.greatest(F.lit(0), 100 - F.col("deduction")).cast("int"))
    )


def rate_limit_windows(
    requests: DataFrame,
    client: str,
    time: str,
    status: str,
    window: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Requests, blocks and first block per client and event-time window.

    A window without a block is one in which no rate limit showed. Rows later than the
    watermark are dropped by the stream.
    """
    blocked = F.col(status).isin(V.BLOCKED_STATUSES)
    return (
        requests.withWatermark(time, lateness)
        .groupBy(F.window(time, window), F.col(client))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(blocked).alias("blocked"),
            F.min(F.when(blocked, F.col(time))).alias("first_blocked_at"),
        )
        .select(
            client,
            F.col("window.start").alias("window_start"),
            "requests",
            "blocked",
            "first_blocked_at",
            (F.col("blocked") > 0).alias("limited"),
        )
    )


def read_listing(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Paths and modification times below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.lit(project).alias("project"),
            "path",
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        )
    )


def watch_tick(listing: DataFrame, state: str, tick: int) -> DataFrame:
    """Save the listing of this tick and return what changed since the one before.

    The listing is the state, since a file stream never reports a removal.
    """
    spark = listing.sparkSession
    write_batch(listing, f"{state}/listing", tick)
    now = spark.read.parquet(f"{state}/listing/batch_id={tick}")
    before = now.limit(0) if tick == 0 else spark.read.parquet(f"{state}/listing/batch_id={tick - 1}")
    return listing_changes(before, now)
