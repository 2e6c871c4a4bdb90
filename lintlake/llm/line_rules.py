"""Quality rules: counts of each text, and lines that too many documents of one host share.

A host is the ``source`` column; a null host is the host ''. Null and empty texts have no words
and fail the base rule. A line is compared by its words in lower case; lines without a word don't
count. Every document counts, copies of a text too; rows that repeat both id and text are one
document. Repeated rows get the same verdict, ties don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Run, runs, span_hashes, window_hashes
from .tables import free_name, stored

#: A line is above the limit in more than this many documents of its host, however many it has,
MIN_DOCUMENTS = 10
#: or in more than this share of them, where the host is small,
MAX_SHARE = 0.1
#: but never in fewer documents than this.
LEAST_DOCUMENTS = 3
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"doc_id long, host long, {MEASURES}, content long, lines array<struct<line: long, words: int>>"


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def line_spans(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every \\n-split line, and its text's number; an empty text has one empty line."""
    breaks = np.flatnonzero(run.data == 10)
    owner = np.searchsorted(run.offsets[1:], breaks, side="right")
    starts = np.concatenate((run.offsets[:-1], breaks + 1))
    ends = np.concatenate((breaks, run.offsets[1:]))
    order = np.lexsort((starts, np.concatenate((np.arange(run.n), owner))))
    end_order = np.lexsort((ends, np.concatenate((owner, np.arange(run.n)))))
    return starts[order], ends[end_order], np.concatenate((np.arange(run.n), owner))[order]


def normal_lines(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Per line of ``line_spans``: hash of its lower-cased words, and how many there are."""
    starts, ends, _ = line_spans(run)
    word_starts, _, _ = run.words
    low, high = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    return span_hashes(run.word_hashes(lower=True), low, high), high - low


def measure(run: Run) -> dict[str, list | np.ndarray]:
    starts, ends, first = run.words
    hashes = run.word_hashes()
    line_start, line_end, line_owner = line_spans(run)
    raw = span_hashes(hashes_of_bytes(run.data), line_start, line_end)
    normal, line_words = normal_lines(run)
    edges = np.searchsorted(line_owner, np.arange(run.n + 1))
    word_bytes = np.zeros(len(run.data) + 1, np.int64)
    np.add.at(word_bytes, starts, 1)
    np.add.at(word_bytes, ends, -1)
    in_word = np.cumsum(word_bytes[:-1]) > 0
    content = span_hashes(hashes_of_bytes(run.data), run.offsets[:-1], run.offsets[1:])
    out: dict = {
        "n_words": np.diff(first), "word_chars": run.sums(in_word & ((run.data & 0xC0) != 0x80)), "n_symbols": run.sums(_SYMBOLS[run.data]),
        "n_dup_lines": [], "n_repeat_words": [], "content": content.view(np.int64), "lines": [],
    }
    for i in range(run.n):
        a, b = edges[i], edges[i + 1]
        full = line_words[a:b] > 0
        out["n_dup_lines"].append(int(full.sum()) - len(np.unique(raw[a:b][full])))
        again = np.flatnonzero(_repeats(window_hashes(hashes[first[i] : first[i + 1]], 3)))
        covered = np.zeros(first[i + 1] - first[i], bool)
        for k in range(3):
            covered[again + k] = True
        out["n_repeat_words"].append(int(covered.sum()))
        line, at = np.unique(normal[a:b][full], return_inverse=True)
        words = np.bincount(at, line_words[a:b][full], len(line)).astype(int)
        out["lines"].append([{"line": x, "words": w} for x, w in zip(line.view(np.int64).tolist(), words.tolist(), strict=True)])
    return out


_BYTE_HASH = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def hashes_of_bytes(data: np.ndarray) -> np.ndarray:
    return _BYTE_HASH[data]


def measured(docs: DataFrame) -> DataFrame:
    """One row per document: counts, a hash of the text, and its distinct lines with the words they hold."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                part = batch.slice(run.first, run.n)
                columns = {k: v if k == "lines" else pa.array(v, pa.int64()) for k, v in measure(run).items()}
                columns["lines"] = pa.array(columns["lines"], pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "host": part.column("host"), **columns})

    host = F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")))
    return docs.select("doc_id", host.alias("host"), "text").mapInArrow(run_batches, _SCHEMA)


def line_rows(rows: DataFrame) -> DataFrame:
    """host, content, line, words: every distinct line of every distinct text of a host."""
    return rows.select("host", "content", F.inline("lines")).distinct()


def frequent_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line, documents: lines that more documents of a host hold than one of the limits allows."""
    totals = rows.select("host", "doc_id", "content").distinct().groupBy("host").agg(F.count("*").alias("total"))
    held = rows.select("host", "doc_id", "content", F.explode("lines.line").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("documents"))
    return (
        counts.where(F.col("documents") >= LEAST_DOCUMENTS)
        .join(totals, "host")
        .where((F.col("documents") > min_documents) | (F.col("documents") > F.col("total") * max_share))
        .select("host", "line", "documents")
    )


def judge(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the measures, base_failed, n_removed (words in frequent lines) and kept, for every row."""
    rows = stored(measured(docs), "line-measures")
    frequent = frequent_lines(rows, min_documents, max_share)
    removed = line_rows(rows).join(frequent, ["host", "line"]).groupBy("host", "content").agg(F.sum("words").alias("n_removed"))
    words, gone = F.col("n_words"), F.coalesce("n_removed", F.lit(0))
    failed = (words < 50) | (100 * F.col("n_repeat_words") > 50 * words)
    return (
        rows.drop("lines")
        .join(removed, ["host", "content"], "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
            (~failed & (words - gone >= min_left * words)).alias("kept"), gone.cast("long").alias("n_removed"),
        )
    )


def without_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents with their frequent lines cut out of the text; other columns and all rows stay."""
    rows = stored(measured(docs), "line-measures")
    lists = (
        line_rows(rows).join(frequent_lines(rows, min_documents, max_share), ["host", "line"])
        .groupBy("host", "content").agg(F.collect_list("line").alias("gone"))
    )  # a list holds lines of one text only
    gone = rows.select("doc_id", "host", "content").join(lists, ["host", "content"]).groupBy("doc_id", "host").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    name, own_id, own_host = (free_name(docs, n) for n in ("gone", "gone_id", "gone_host"))
    host = F.xxhash64(F.coalesce(docs["source"].cast("string"), F.lit("")))
    named = gone.select(F.col("doc_id").alias(own_id), F.col("host").alias(own_host), F.col("gone").alias(name))
    joined = docs.join(named, docs["doc_id"].eqNullSafe(F.col(own_id)) & (host == F.col(own_host)), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], name)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lists_, lines = batch.column(name).to_pylist(), {}
            for run in runs(batch.column("text")):
                _, _, owner = line_spans(run)
                normal, words = normal_lines(run)
                edges = np.searchsorted(owner, np.arange(run.n + 1))
                for i in range(run.n):
                    if lists_[run.first + i]:
                        a, b = edges[i], edges[i + 1]
                        lines[run.first + i] = (words[a:b] > 0) & np.isin(normal[a:b].view(np.int64), lists_[run.first + i])
            new = ["\n".join(x for x, drop in zip(t.split("\n"), lines[i], strict=True) if not drop) if i in lines else t for i, t in enumerate(texts)]
            kept = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in kept], names=kept)

    return joined.mapInArrow(cut, docs.schema)
