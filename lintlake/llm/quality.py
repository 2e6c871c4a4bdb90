"""Quality classifier: gradient-boosted trees over statistics of the whole text.

Inputs of the score come from the text alone. Null and empty texts have statistics of 0 and get
the score the trees give those; every row gets a score, repeated rows the same one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Run, runs, windows_within, window_hashes, mix
from .boosting import Trees, fit
from .tables import free_name

#: Labelled rows that the trees are fitted on at most; which ones is decided by a hash of the id.
TRAIN_ROWS = 8000

FEATURES = [
    "log_chars", "log_words", "word_length", "longest_word", "line_words", "upper", "digits", "punctuation", "symbols",
    "bars", "bangs", "sentence_ends", "non_ascii", "spaces", "distinct_words", "repeated_triples", "repeated_lines",
    "top_word", "short_words", "capital_words", "marked_words",
]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_PUNCTUATION, _SYMBOL = _class(".,;:?'\"()-"), _class("#*$%&<>@^~_=+{}[]\\/`")
_ALNUM = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | (np.arange(256) >= 128)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: distinct values, values that occur again, the count of the commonest."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(o)))
    distinct = np.bincount(o[at], minlength=n)
    again = np.bincount(o[at], np.where(size > 1, size, 0), n)
    top = np.zeros(n)
    np.maximum.at(top, o[at], size)
    return distinct, again, top


def statistics(run: Run) -> np.ndarray:
    """One row of FEATURES per text."""
    data, n = run.data, run.n
    starts, ends, first = run.words
    words = np.diff(first).astype(float)
    size = np.diff(run.offsets).astype(float)
    chars = run.sums((data & 0xC0) != 0x80).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = ends - starts
    hashes = run.word_hashes()
    distinct, _, top = _distinct(owner, hashes, n)
    inside, at = windows_within(first, 3)
    triples = window_hashes(hashes, 3)[inside]
    _, again, _ = _distinct(at[inside], triples, n)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    newline = data == 10
    lines = run.sums(newline) + (size > 0)
    # a line's hash: the sum of its word hashes, mixed by place
    line_at = np.concatenate(([0], np.cumsum(newline)))[starts] + owner if len(starts) else np.zeros(0, np.int64)
    if len(starts):
        cut = np.flatnonzero(np.concatenate(([True], (line_at[1:] != line_at[:-1]))))
        place = np.arange(len(starts)) - np.repeat(cut, np.diff(np.append(cut, len(starts))))
        line_hash = np.add.reduceat(mix(hashes + place.astype(np.uint64)), cut)
        line_count, line_again, _ = _distinct(owner[cut], line_hash, n)
        full_lines = np.bincount(owner[cut], minlength=n)
    else:
        line_again, full_lines = np.zeros(n), np.zeros(n)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    by_word = lambda flags: np.bincount(owner, flags, n) / per_word
    by_byte = lambda table: run.sums(table[data]) / per_byte
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(words), np.bincount(owner, length, n) / per_word, longest, words / np.maximum(lines, 1),
            by_byte(_UPPER), by_byte(_DIGIT), by_byte(_PUNCTUATION), by_byte(_SYMBOL), run.sums(data == 124) / per_byte,
            run.sums(data == 33) / per_byte, run.sums((data == 46) | (data == 63)) / per_word, run.sums(data >= 128) / per_byte,
            run.sums(data == 32) / per_byte, distinct / per_word, again / per_word, line_again / np.maximum(full_lines, 1),
            top / per_word, by_word(length <= 3), by_word(_UPPER[head]), by_word(~_ALNUM[last]),
        ]
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 0 modulo 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, label of the sample. Conflicting labels of one id count as 0; null labels and ids don't count."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)  # the documented bound of the training sample
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on the statistics of at most ``rows`` labelled documents."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                part = batch.slice(run.first, run.n)
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "label": part.column("label").cast(pa.int32()), "x": pa.array(list(statistics(run)), pa.list_(pa.float64()))})

    sample = training_rows(docs, labels, rows).mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas()
    sample = sample.assign(first=sample.x.str[0]).sort_values(["doc_id", "first"]).drop_duplicates("doc_id")
    x = np.array(sample.x.tolist()).reshape(-1, len(FEATURES))
    return fit(x, sample.label.to_numpy(float), trees=80, depth=4, rate=0.12)


def score(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """The rows with the trees' probability of label 1. A column of the same name is replaced."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [trees.probability(statistics(run)) for run in runs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run_trees, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, rows))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    name = free_name(docs, "score")
    return score(docs, train(docs, labels, rows), name).where(F.col(name) >= threshold).drop(name)
