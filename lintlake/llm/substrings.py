"""Substring dedup: words covered by a window of WINDOW words that also starts elsewhere are cut.

The suffixes that matter start at windows which can repeat at all. Each window has an anchor: the
first of the smallest hashes of its runs of ANCHOR words. Equal windows have equal anchors at
equal places, so only windows whose anchor occurs twice or more go on. The anchor is the
prefix that parts suffixes into groups; where an anchor has more than GROUP places the prefix grows to
the whole window, and such groups are counted without being held: windows found once are told apart from the rest. A group's suffix tree is
grown from the top, level by level: a node splits by the next words, nodes of a single suffix end, and the
nodes that reach the depth of a window are the deep internal nodes, whose suffixes are repeats.

Texts that occur twice or more have all their windows elsewhere; one of them stands for them in the tree.
Null and empty texts have no words; texts shorter than a window lose nothing. Repeated rows
are copies of each other. Rows with a null id are handled like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, runs, span_hashes, window_hashes
from .tables import free_name, stored

WINDOW = 35
ANCHOR = 8
#: Places of one anchor that are held as a group at most.
GROUP = 4096

EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(words: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window of a text: the hash of its anchor, and the word at which that starts."""
    grams = window_hashes(words, width)
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    span = window - width + 1
    at = np.empty(len(words) - window + 1, np.int64)
    for i in range(0, len(at), 1 << 16):
        view = sliding_window_view(grams[i : i + (1 << 16) + span - 1], span)[: len(at) - i]
        at[i : i + len(view)] = view.argmin(axis=1) + np.arange(i, i + len(view))
    return grams[at], at


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _cls(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _described(docs: DataFrame, window: int, width: int) -> DataFrame:
    """doc_id, cls, n_words, whole (digest of all words), anchors with the number of places each has in the text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes = run.word_hashes()
                _, _, first = run.words
                whole, found, places = [], [], []
                for i in range(run.n):
                    whole.append(_digest(run.text(i)))
                    gram, at = anchors(hashes[first[i] : first[i + 1]], window, width)
                    gram = gram[np.unique(at, return_index=True)[1]]
                    value, count = np.unique(gram, return_counts=True)
                    found.append(value.view(np.int64))
                    places.append(count)
                edges = np.cumsum([0, *map(len, found)])
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(places), pa.int32())], names=["anchor", "n"])
                part = batch.slice(run.first, run.n)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"), "cls": part.column("cls"), "n_words": pa.array(np.diff(first), pa.int64()),
                        "whole": pa.array(whole, pa.string()), "anchors": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _cls().alias("cls"), "text").mapInArrow(
        describe, "doc_id long, cls binary, n_words long, whole string, anchors array<struct<anchor: long, n: int>>"
    )


_PLACES = pa.list_(pa.struct([("anchor", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))


def _candidates(docs: DataFrame, wanted: DataFrame, window: int, width: int) -> DataFrame:
    """cls, text, places: of each wanted text, its runs of windows with one repeated anchor: anchor, its place, first and last window."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated = batch.column("repeated")
            for run in runs(batch.column("text")):
                hashes = run.word_hashes()
                _, _, first = run.words
                out = []
                for i in range(run.n):
                    gram, at = anchors(hashes[first[i] : first[i + 1]], window, width)
                    known = np.isin(gram.view(np.int64), repeated[run.first + i].values.to_numpy())
                    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1])))) if len(at) else np.empty(0, np.int64)
                    last = np.append(edge[1:], len(at)) - 1
                    use = known[edge]
                    out.append([{"anchor": g, "at": a, "low": x, "high": y} for g, a, x, y in zip(gram.view(np.int64)[edge][use].tolist(), at[edge][use].tolist(), edge[use].tolist(), last[use].tolist(), strict=True)])
                part = batch.slice(run.first, run.n)
                yield pa.record_batch({"cls": part.column("cls"), "text": part.column("text"), "places": pa.array(out, _PLACES)})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", _cls().alias("own"))
    texts = texts.join(wanted, (F.col("own") == F.col("cls")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("cls", "text", "repeated")
    return texts.mapInArrow(place, "cls binary, text string, places array<struct<anchor: long, at: int, low: int, high: int>>")


def _marked(candidates: DataFrame, hot: DataFrame) -> DataFrame:
    """The candidates with ``hot``: those of their anchors that have too many places to be held."""
    rows = candidates.select("cls", F.inline("places"))
    pairs = rows.join(hot.select("anchor"), "anchor").select("cls", "anchor").distinct()
    by_text = stored(pairs.groupBy("cls").agg(F.collect_list("anchor").alias("hot")), "hot-anchors")
    return candidates.join(by_text, "cls", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))


def _held(texts: DataFrame, window: int) -> DataFrame:
    """anchor, cls, at, low, words: the stretches whose anchor's group is held."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes = run.word_hashes()
                _, _, first = run.words
                out = []
                for i in range(run.n):
                    k, words = run.first + i, hashes[first[i] : first[i + 1]]
                    cls = batch.column("cls")[k].as_py()
                    anchor, at, low, high, hot = _places(batch, k)
                    use = ~hot
                    out += [(g, cls, p, a, words[a : b + window].tobytes()) for g, p, a, b in zip(anchor[use].tolist(), at[use].tolist(), low[use].tolist(), high[use].tolist(), strict=True)]
                types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                columns = zip(*out, strict=True) if out else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "cls", "at", "low", "words"])

    return texts.mapInArrow(cut, "anchor long, cls binary, at int, low int, words binary")


def _places(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Of text k: anchor, its place, first and last window of each stretch, and whether the anchor is hot."""
    places = batch.column("places")[k].values
    anchor, at, low, high = (places.field(n).to_numpy(zero_copy_only=False) for n in range(4))
    return anchor, at, low, high, np.isin(anchor, batch.column("hot")[k].values.to_numpy())


def _singles(texts: DataFrame, window: int) -> DataFrame:
    """cls, singles: per text, the windows with a hot anchor that start nowhere else.

    Windows are counted, with partial sums before the shuffle. A window that occurs once has one place, which the
    minimum returns; places of the others are never gathered nor joined.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes = run.word_hashes()
                _, _, first = run.words
                out = []
                for i in range(run.n):
                    k = run.first + i
                    anchor, _, low, high, hot = _places(batch, k)
                    if hot.any():
                        low, size = low[hot].astype(np.int64), (high.astype(np.int64) - low + 1)[hot]
                        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                        whole = window_hashes(hashes[first[i] : first[i + 1]], window).view(np.int64)
                        own = np.frombuffer(batch.column("cls")[k].as_py(), ">i8").astype(np.int64)
                        out.append((np.repeat(anchor[hot], size), whole[at], at, *(np.full(len(at), x) for x in own)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "hash", "low", "a", "b"])

    hot = texts.where(F.size("hot") > 0).select("cls", "text", "places", "hot")
    windows = hot.mapInArrow(cut, "anchor long, hash long, low long, a long, b long")
    once = windows.groupBy("anchor", "hash").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("low", "a", "b")]).where("n = 1")
    cls = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("a", "b")]))
    return once.groupBy("a", "b").agg(F.collect_list("low").alias("singles")).select(cls.alias("cls"), "singles")


def tree_repeats(anchor: np.ndarray, before: np.ndarray, sizes: np.ndarray, words: np.ndarray, window: int, step: int = 9) -> np.ndarray:
    """Which suffixes hang below a node of depth ``window`` with two suffixes or more.

    Stretch k has ``sizes[k]`` words, its anchor after ``before[k]`` of them, and a suffix for each of its windows.
    Suffixes come in the order of stretches. The first branching is by anchor and its place, the next ones by ``step`` words.
    """
    windows = sizes - window + 1
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(windows)))[:-1], windows)
    start = base[owner] + offset
    node = mix(anchor.view(np.uint64)[owner] + mix((before[owner] - offset).astype(np.uint64)))
    active, depth = np.arange(len(owner)), 0
    while len(active):
        _, inverse, count = np.unique(node, return_inverse=True, return_counts=True)
        more = count[inverse] > 1
        active, inverse = active[more], inverse[more]
        if depth == window or not len(active):
            break
        width = min(step, window - depth)
        at = start[active] + depth
        node = mix(inverse.astype(np.uint64)) + span_hashes(words, at, at + width)
        depth += width
    out = np.zeros(len(owner), bool)
    out[active] = True
    return out


def _ranges(flags: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows: owner, first and last start."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate(([True], (owner[at[1:]] != owner[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return owner[first], start[first], start[last]


def _held_repeats(held: DataFrame, window: int) -> DataFrame:
    """cls, low, high: runs of repeated windows, found by the trees of the anchors' groups."""

    def grow(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, at, low = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "at", "low"))
        texts = table.column("words").to_pylist()
        words = np.frombuffer(b"".join(texts), np.uint64)
        sizes = np.array([len(t) // 8 for t in texts])
        flags = tree_repeats(anchor, at - low, sizes, words, window)
        windows = sizes - window + 1
        owner = np.repeat(np.arange(len(sizes)), windows)
        start = low[owner] + np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(windows)))[:-1], windows)
        rows, lo, hi = _ranges(flags, owner, start)
        return pa.record_batch({"cls": table.column("cls").combine_chunks().take(pa.array(rows)), "low": pa.array(lo, pa.int32()), "high": pa.array(hi, pa.int32())})

    def run_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in (whole.slice(i, 8192) for i in range(0, whole.num_rows, 8192)):
                last = batch.column("anchor")[-1].as_py()
                mine = batch.column("anchor").to_numpy() == last
                cut = 0 if mine.all() else int(np.flatnonzero(~mine).max()) + 1
                if rows and (cut or rows[-1].column("anchor")[-1].as_py() != last):
                    if cut:
                        rows.append(batch.slice(0, cut))
                    yield grow(pa.Table.from_batches(rows))
                    rows = [batch.slice(cut)]
                elif cut:
                    yield grow(pa.Table.from_batches([batch.slice(0, cut)]))
                    rows = [batch.slice(cut)]
                else:
                    rows.append(batch)
        if rows:
            yield grow(pa.Table.from_batches(rows))

    return held.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run_groups, "cls binary, low int, high int")


def repeated_windows(docs: DataFrame, classes: DataFrame, window: int = WINDOW, width: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """The candidate texts: cls, text, places, hot, ranges and singles.

    Windows that repeat are those of ``ranges``, and those of the stretches with a hot anchor except ``singles``.
    """
    found = classes.select(F.xxhash64("cls").alias("id"), F.inline("anchors"))
    counts = stored(found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    lists = found.select("id", "anchor").join(counts.select("anchor"), "anchor").groupBy("id").agg(F.collect_set("anchor").alias("repeated"))
    wanted = classes.withColumn("id", F.xxhash64("cls")).join(lists, "id").select("cls", "doc_id", "repeated")
    candidates = stored(_candidates(docs, wanted, window, width).dropDuplicates(["cls"]), "candidates")

    texts = _marked(candidates, counts.where(F.col("n") > group))
    ranges = _held_repeats(_held(texts, window), window).groupBy("cls").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return texts.join(ranges, "cls", "left").join(_singles(texts, window), "cls", "left")


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """cls, n_removed, kept (the words left, joined by a space) of the texts that lose words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, kept, removed = [], [], []
            for k, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                # One more for each repeated window that starts, one less where it ends; windows that start once don't count.
                starts = np.zeros(len(words) + 2, np.int64)
                if batch.column("ranges")[k].is_valid:
                    low, high = (batch.column("ranges")[k].values.field(n).to_numpy(zero_copy_only=False) for n in (0, 1))
                    np.add.at(starts, low, 1)
                    np.add.at(starts, high + 1, -1)
                _, _, low, high, hot = _places(batch, k)
                np.add.at(starts, low[hot], 1)
                np.add.at(starts, high[hot] + 1, -1)
                starts = np.cumsum(starts[:-1]) > 0
                if batch.column("singles")[k].is_valid:
                    starts[batch.column("singles")[k].values.to_numpy()] = False
                sums = np.concatenate((np.zeros(window, np.int64), np.cumsum(starts[:-1])))
                out = sums[window:] > sums[:-window]
                if out.any():
                    classes.append(batch.column("cls")[k].as_py())
                    removed.append(int(out.sum()))
                    kept.append(b" ".join([w for w, drop in zip(words, out.tolist(), strict=True) if not drop]).decode())
            yield pa.record_batch({"cls": pa.array(classes, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return texts.select("cls", "text", "places", "hot", "ranges", "singles").mapInArrow(cut, "cls binary, n_removed long, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, cls, n_words, whole, copies) of every document, and (cls, n_removed, kept) of texts that lose words.

    Texts with copies and a window or more lose all their words and aren't among the latter.
    """
    rows = stored(_described(docs, window, width), "words")
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors"), F.count("*").alias("copies"))
    classes = stored(classes, "texts")
    shortened = _kept(repeated_windows(docs, classes, window, width, group), window)
    return rows.select("doc_id", "cls", "n_words", "whole").join(classes.select("cls", "copies"), "cls"), shortened


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, shortened = dedup(docs, window)
    cut = shortened.select("cls", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("digest"))
    everything = (F.col("copies") > 1) & (F.col("n_words") >= window)
    joined = rows.join(cut, "cls", "left")
    return joined.select(
        "doc_id", "n_words", F.when(everything, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(everything, EMPTY).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words cut from their texts; a text that loses none stays as it is."""
    rows, shortened = dedup(docs, window)
    kept, cls = free_name(docs, "kept_text"), free_name(docs, "text_class")
    whole = rows.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("cls", F.lit("").alias(kept)).distinct()
    cut = rows.where((F.col("copies") == 1) | (F.col("n_words") < window)).select("cls").distinct().join(shortened, "cls").select("cls", F.col("kept").alias(kept))
    new = whole.union(cut).withColumnRenamed("cls", cls)
    joined = docs.withColumn(cls, _cls()).join(new, cls, "left")
    return joined.select(*[F.coalesce(kept, "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
