"""Benchmark decontamination: spaced seeds join test and training texts, overlaps are verified with substitutions.

Words lose outer ASCII punctuation and are lower-cased (A-Z); words of punctuation alone don't count.
A seed is a mask laid over the words: the hash of the words at its fixed offsets, the others ignored.
Every text of the benchmark and of the corpus is hashed under all masks at every position. Equal hashes
put a document and an item on a diagonal, and on it the words are compared one by one: the document
is contaminated if SIMILARITY of a window of min(words of the item, WINDOW) words agree.

The masks leave a seed untouched by any two substitutions in ten to fourteen words and by any
three in fifteen; shorter items are found as exact copies at least. Items with fewer than five
words are no evidence and never match; null and empty texts have no words. Repeated rows and items
give one row per pair of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, Run, _BYTE_VALUES, mix, powers, runs, span_hashes
from .tables import free_name, stored

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
WINDOW = 20
SIMILARITY = 0.8
#: The filter of benchmark seeds that goes to every task has this many 64-bit words, whatever the benchmark's size.
FILTER_WORDS = 1 << 18

_OUTER = np.zeros(256, bool)
_OUTER[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_STEP = np.uint64(0xD1342543DE82EF95)


def plain_words(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words, and the first of each text (n + 1 values)."""
    starts, ends, first = run.words
    starts, ends = starts.copy(), ends.copy()
    while True:
        cut = np.flatnonzero((starts < ends) & _OUTER[run.data[np.minimum(starts, max(0, len(run.data) - 1))]]) if len(starts) else []
        if not len(cut):
            break
        starts[cut] += 1
    while True:
        cut = np.flatnonzero((starts < ends) & _OUTER[run.data[ends - 1]]) if len(starts) else []
        if not len(cut):
            break
        ends[cut] -= 1
    full = starts < ends
    owner = np.repeat(np.arange(run.n), np.diff(first))[full]
    hashes = np.empty(int(full.sum()), np.uint64)
    starts, ends = starts[full], ends[full]
    values, i = _BYTE_VALUES[LOWER], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (4 << 20))))
        hashes[i:j] = span_hashes(values[run.data[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return hashes, np.searchsorted(owner, np.arange(run.n + 1))


def seeds(hashes: np.ndarray, first: np.ndarray, masks=MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask: seed hashes, and the positions of their first words; seeds lie within one text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for number, mask in enumerate(masks):
        n = len(hashes) - mask[-1]
        if n <= 0:
            continue
        total = np.full(n, number + 1, np.uint64)
        for offset, factor in zip(mask, powers(_STEP, 16)[1:], strict=False):
            total += hashes[offset : offset + n] * factor
        at = np.flatnonzero(owner[:n] == owner[mask[-1] :])
        yield mix(total[at]), at


def items(benchmark: DataFrame, masks=MASKS) -> DataFrame:
    """item_id, n, words, seeds of every benchmark row with five words or more."""

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes, first = plain_words(run)
                found: list[list[dict]] = [[] for _ in range(run.n)]
                for seed, at in seeds(hashes, first, masks):
                    text = np.searchsorted(first, at, side="right") - 1
                    for s, p, t in zip(seed.view(np.int64).tolist(), (at - first[text]).tolist(), text.tolist(), strict=True):
                        found[t].append({"seed": s, "place": p})
                n = np.diff(first)
                keep = np.flatnonzero(n >= len(masks[0]))
                ids = batch.column("item_id").slice(run.first, run.n).cast(pa.int64())
                yield pa.record_batch(
                    {
                        "item_id": ids.take(pa.array(keep)), "n": pa.array(n[keep], pa.int32()),
                        "words": pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in keep], pa.binary()),
                        "seeds": pa.array([found[i] for i in keep], pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))),
                    }
                )

    return benchmark.select("item_id", "text").mapInArrow(hash_items, "item_id long, n int, words binary, seeds array<struct<seed: long, place: int>>")


def seed_filter(tests: DataFrame, words: int = FILTER_WORDS) -> np.ndarray:
    """A Bloom filter of the seeds, fixed in size and put together by Spark: one bit for a seed, one for it rotated."""
    seed = tests.select(F.explode("seeds.seed").alias("seed"))
    bits = seed.select(F.explode(F.array(F.col("seed"), F.shiftleft("seed", 21).bitwiseOR(F.shiftrightunsigned("seed", 43)))).alias("h"))
    rows = bits.groupBy(F.col("h").bitwiseAND(F.lit(words - 1)).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")).alias("bits")).toPandas()
    out = np.zeros(words, np.uint64)
    out[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (table[hashes & np.uint64(len(table) - 1)] >> (hashes >> np.uint64(58))) & np.uint64(1) == 1


def hits(docs: DataFrame, table: np.ndarray, longest: int, masks=MASKS) -> DataFrame:
    """doc_id, at, words, found: documents with seeds that pass the filter, the words around them, and the seeds."""
    spread = docs.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = spread.value
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes, first = plain_words(run)
                found = []
                for seed, at in seeds(hashes, first, masks):
                    hit = _bit(one, seed)
                    hit[hit] = _bit(one, (seed[hit] << np.uint64(21)) | (seed[hit] >> np.uint64(43)))
                    found.append((seed[hit], at[hit]))
                if not found or not sum(len(s) for s, _ in found):
                    continue
                seed, at = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                text = np.searchsorted(first, at, side="right") - 1
                edges = [*np.flatnonzero(np.diff(text, prepend=-1)), len(text)]
                ids = batch.column("doc_id").slice(run.first, run.n).cast(pa.int64())
                rows: dict[str, list] = {"at": [], "words": [], "found": []}
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    a, b = first[text[i]], first[text[i] + 1]
                    lo, hi = max(a, at[i] - longest), min(b, at[j - 1] + longest + masks[-1][-1])
                    rows["at"].append(int(lo - a))
                    rows["words"].append(hashes[lo:hi].tobytes())
                    rows["found"].append([{"seed": s, "place": p} for s, p in zip(seed[i:j].view(np.int64).tolist(), (at[i:j] - lo).tolist(), strict=True)])
                yield pa.record_batch(
                    {
                        "doc_id": ids.take(pa.array(text[edges[:-1]])), "at": pa.array(rows["at"], pa.int64()), "words": pa.array(rows["words"], pa.binary()),
                        "found": pa.array(rows["found"], pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, at long, words binary, found array<struct<seed: long, place: int>>")


def overlap(text: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW) -> tuple[int, int, int]:
    """Of the windows of the item laid at ``shift``: agreeing words of the best one, its size, and its place in the item."""
    size = min(window, len(item))
    same = np.zeros(len(item), np.int64)
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if lo < hi:
        same[lo:hi] = text[shift + lo : shift + hi] == item[lo:hi]
    total = np.concatenate(([0], np.cumsum(same)))
    sums = total[size:] - total[:-size]
    best = int(sums.argmax())
    return int(sums[best]), size, best


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, masks=MASKS) -> DataFrame:
    """doc_id, item_id, start (normalised words before the overlap), size and agreeing words of the best window."""
    tests = stored(items(benchmark, masks), "items")
    longest = tests.agg(F.max("n")).first()[0] or 0
    rows = stored(hits(docs, seed_filter(tests), longest, masks).withColumn("row", F.xxhash64("words")), "hits")
    key = ["doc_id", "at", "row"]
    found = rows.select(*key, F.inline("found")).withColumnRenamed("place", "p")
    diagonals = found.join(tests.select("item_id", F.inline("seeds")), "seed").select(*key, "item_id", (F.col("p") - F.col("place")).alias("shift")).distinct()

    left = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    texts = rows.dropDuplicates(key).select(*key, F.col("words").alias("text"))
    pairs = diagonals.alias("d").join(texts.alias("r"), left[0] & left[1] & left[2]).select("d.doc_id", "d.at", "d.item_id", "d.shift", "r.text")
    pairs = pairs.join(tests.select(F.col("item_id").alias("id"), F.col("words").alias("item")), F.col("item_id").eqNullSafe(F.col("id"))).drop("id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, at, item_id, shift, text, item in zip(*(batch.column(c) for c in ("doc_id", "at", "item_id", "shift", "text", "item")), strict=True):
                words = np.frombuffer(item.as_buffer(), np.uint64)
                same, size, place = overlap(np.frombuffer(text.as_buffer(), np.uint64), words, shift.as_py(), window)
                if same >= similarity * size:
                    out.append((doc_id.as_py(), item_id.as_py(), at.as_py() + shift.as_py() + place, size, same))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "size", "agreeing"])

    verified = pairs.mapInArrow(verify, "doc_id long, item_id long, start long, size long, agreeing long")
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("agreeing", "size", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.start")).alias("start"), F.col("best.size").alias("size"), F.col("best.agreeing").alias("agreeing"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark text, with their own columns.

    Rows that share an id, or have none, are told apart by their text.
    """
    name = free_name(docs, "leaked")
    marked = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    leaks = contaminated(marked, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, F.xxhash64(docs["doc_id"], docs["text"]) == leaks[name], "left_anti")
