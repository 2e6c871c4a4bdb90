"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's set holds the hashes of its distinct five-word shingles (A-Z lower-cased). A signature
has SYMBOLS MinHash values of 16 bits. It is cut into CHUNKS chunks; RELAXED of them allow one
differing symbol and the others none. If two signatures differ in at most
CHUNKS + RELAXED - 1 = DISTANCE symbols, some chunk of theirs differs by no more than it allows
(pigeonhole), and the enumerated variants of that chunk meet under one key. Two sets of similarity
0.85 stay within the distance with a probability above 0.99999; for a lower similarity more chunks are relaxed
until that holds as well. Every pair found is confirmed on the full sets, so no false link remains.

Equal sets form a class first. A bucket gives a minimum spanning forest of the pairs within the distance,
so what comes out grows with the bucket and not with its square; all links lie inside the clusters which
the forests connect. Each class is first compared with its nearest class; after that only classes
of one cluster that aren't connected yet are. Buckets and clusters beyond a number of classes are split
into blocks and worked on as pairs of blocks.

Null or empty texts have an empty set and are linked with nothing. Repeated rows are copies. Rows
with a null id take part; a component's id is the smallest id in it, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Run, mix, runs, span_hashes, window_hashes
from .components import components
from .tables import free_name, stored

SHINGLE = 5
SYMBOLS = 64
CHUNKS = 16
RELAXED = 8
DISTANCE = CHUNKS + RELAXED - 1
#: A pair at the similarity asked for lies beyond the distance with at most this probability.
MISSED = 1e-5
#: Classes of a bucket, and full sets of a cluster, that one task compares at once.
BLOCK = 4096
SET_BLOCK = 768
#: The filter of ids whose texts are read again: bits for each id, and 64-bit words at most.
ID_BITS = 8
ID_WORDS = 1 << 20
_WIDTH = SYMBOLS // CHUNKS

_random = np.random.default_rng(85)
_FACTORS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)

CLASS = "struct<a: long, b: long>"


def shingle_sets(run: Run) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    hashes = run.word_hashes(lower=True)
    _, _, first = run.words
    for i in range(run.n):
        words = hashes[first[i] : first[i + 1]]
        if 0 < len(words) < SHINGLE:
            yield span_hashes(words, np.array([0]), np.array([len(words)]))
        else:
            yield np.unique(window_hashes(words, SHINGLE))


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    a = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(shingles + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int((b ^ np.uint64(len(shingles))).view(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit MinHash values."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _structs(a, b) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (null for an empty set) and signature of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column("text")):
                sizes, ids, marks = [], [], []
                for shingles in shingle_sets(run):
                    sizes.append(len(shingles))
                    ids.append(set_id(shingles) if len(shingles) else None)
                    marks.append(signature(shingles).tobytes() if len(shingles) else None)
                part = batch.column("doc_id").slice(run.first, run.n).cast(pa.int64())
                cls = pa.array([x and {"a": x[0], "b": x[1]} for x in ids], pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.record_batch({"doc_id": part, "n_shingles": pa.array(sizes, pa.int64()), "cls": cls, "signature": pa.array(marks, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id long, n_shingles long, cls {CLASS}, signature binary")


def missed(percent: int, distance: int) -> float:
    """Probability that two sets of a similarity differ in more symbols than the distance."""
    same = percent / 100
    return sum(comb(SYMBOLS, k) * (1 - same) ** k * same ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))


def relaxed(percent: int) -> int:
    """How many chunks are relaxed for a similarity: RELAXED, or as many more as MISSED asks for."""
    return next((n for n in range(RELAXED, CHUNKS) if missed(percent, CHUNKS + n - 1) <= MISSED), CHUNKS)


def chunk_keys(marks: np.ndarray, relaxed: int = RELAXED) -> np.ndarray:
    """Keys of signatures (rows of SYMBOLS values): one for each variant of each chunk that is allowed."""
    wide = marks.astype(np.uint64).reshape(len(marks), CHUNKS, _WIDTH)
    whole = (wide << (np.arange(_WIDTH, dtype=np.uint64) * np.uint64(16))).sum(axis=2, dtype=np.uint64)
    keys = []
    for chunk in range(CHUNKS):
        left_out = range(_WIDTH) if chunk >= CHUNKS - relaxed else [None]
        for symbol in left_out:
            value = whole[:, chunk]
            if symbol is not None:
                value = value & np.uint64(((1 << 64) - 1) ^ (0xFFFF << (16 * symbol)))
            keys.append(mix(mix(value) + np.uint64(chunk * (_WIDTH + 1) + (0 if symbol is None else symbol + 1) + 1)))
    return np.stack(keys, axis=1)


def keyed(classes: DataFrame, relaxed: int = RELAXED) -> DataFrame:
    """key, cls: every class under each of its keys."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                keys = chunk_keys(_marks(part.column("signature")), relaxed)
                a, b = (part.column("cls").field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                n = keys.shape[1]
                yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)), "cls": _structs(np.repeat(a, n), np.repeat(b, n))})

    return classes.select("cls", "signature").mapInArrow(explode, f"key long, cls {CLASS}")


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _sketch(marks: np.ndarray) -> np.ndarray:
    """Four bits of each symbol, as four 64-bit values a row: differing sketches never overstate the distance."""
    nibbles = (marks & np.uint16(15)).astype(np.uint64).reshape(len(marks), 4, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _nibbles(d: np.ndarray) -> np.ndarray:
    """How many nibbles of each value aren't 0."""
    d = d | (d >> np.uint64(1))
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows with equal keys, some at a time, and the groups' edges; rows arrive sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def whole(batches_: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(batches_).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return table, np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1] for k in keys]
        if held and all(held[-1].column(k)[-1].equals(x) for k, x in zip(keys, last, strict=True)):
            held.append(batch)
            continue
        same = np.ones(batch.num_rows, bool)
        for k, x in zip(keys, last, strict=True):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == x.as_py()
        cut = int(np.flatnonzero(~same).max()) + 1 if not same.all() else 0
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield whole(done)
        held = [batch.slice(cut)]
    if held:
        yield whole(held)


def _class_arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return tuple(column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))


def _spanning(n: int, distances) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of n nodes; ``distances(i)`` gives those of node i to all, 255 for none."""
    best, source = np.full(n, 255, np.uint8), np.full(n, -1)
    free, edges = np.ones(n, bool), []
    for _ in range(n):
        at = int(np.where(free, best, 255).argmin())
        if not free[at] or best[at] == 255:
            at = int(free.argmax())
        elif source[at] >= 0:
            edges.append((int(source[at]), at))
        free[at] = False
        far = distances(at)
        closer = free & (far < best)
        best[closer], source[closer] = far[closer], at
    return edges


def _near_pairs(members: DataFrame, percent: int) -> DataFrame:
    """x, y, distance: a minimum spanning forest of each bucket over the pairs within the distance whose sizes allow a link.

    Linear in the bucket, it holds each class's nearest neighbour and connects all pairs of the bucket
    that could be links.
    """
    distance = CHUNKS + relaxed(percent) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, ["key", "i", "j"]):
            marks, size = _marks(table.column("signature").combine_chunks()), table.column("n_shingles").to_numpy()
            sketch = _sketch(marks)
            count = np.diff(edges)
            first, second = [], []
            two = edges[:-1][count == 2]
            for step, at in ((1, two), (1, edges[:-1][count == 3]), (1, edges[:-1][count == 3] + 1), (2, edges[:-1][count == 3])):
                first.append(at)
                second.append(at + step)
            for k in np.flatnonzero(count > 3):
                own, whole, sizes = sketch[edges[k] : edges[k + 1]], marks[edges[k] : edges[k + 1]], size[edges[k] : edges[k + 1]]

                def distances(i: int, own=own, whole=whole, sizes=sizes) -> np.ndarray:
                    # the sketches never overstate; only what they let pass is compared in full
                    fits = (_nibbles(own ^ own[i]).sum(axis=1) <= distance) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
                    out, at = np.full(len(own), 255, np.uint8), np.flatnonzero(fits)
                    far = (whole[at] != whole[i]).sum(axis=1)
                    out[at] = np.where(far <= distance, far, 255)
                    return out

                pairs = np.array(_spanning(len(own), distances), np.int64).reshape(-1, 2) + edges[k]
                first.append(pairs[:, 0])
                second.append(pairs[:, 1])
            p, q = np.concatenate(first), np.concatenate(second)
            far = np.zeros(len(p), np.int64)
            for at in range(0, len(p), 8192):
                far[at : at + 8192] = (marks[p[at : at + 8192]] != marks[q[at : at + 8192]]).sum(axis=1)
            keep = far <= distance
            keep &= 100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q])
            p, q, far = p[keep], q[keep], far[keep]
            if len(p):
                a, b = _class_arrays(table.column("cls"))
                swap = (a[p] > a[q]) | ((a[p] == a[q]) & (b[p] > b[q]))
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                yield pa.record_batch({"x": _structs(a[p], b[p]), "y": _structs(a[q], b[q]), "distance": pa.array(far, pa.int32())})

    return _blocks(members, "key", F.col("blocks")).mapInArrow(emit, f"x {CLASS}, y {CLASS}, distance int")


def _blocks(members: DataFrame, key: str, blocks) -> DataFrame:
    """The rows dealt out by key and pair of blocks (i, j); with one block a row comes once."""
    own = F.when(blocks > 1, F.pmod(F.xxhash64("cls"), blocks)).otherwise(0).cast("int")
    others = F.when(blocks > 1, F.sequence(F.lit(0), (blocks - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("block", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "cls")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("p"), batch.column("q"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("x", "y").join(sets.select(F.col("cls").alias("x"), F.col("shingles").alias("p")), "x")
    joined = joined.join(sets.select(F.col("cls").alias("y"), F.col("shingles").alias("q")), "y")
    return joined.select("x", "y", "p", "q").mapInArrow(compare, f"x {CLASS}, y {CLASS}")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count > 1
    column = (np.cumsum(shared) - 1)[inverse]
    used = shared[inverse]
    owner, column = owner[used], column[used]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """x, y: links between classes of different labels, compared on full sets within each cluster.

    Per pair of blocks only a spanning forest of the labels comes out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, ["cluster", "i", "j"]):
            a, b = _class_arrays(table.column("cls"))
            labels = list(zip(*(x.tolist() for x in _class_arrays(table.column("label"))), strict=True))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            x, y = [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s < 2 or len(set(labels[s:e])) < 2:
                    continue
                sizes = np.array([len(v) for v in sets[s:e]])
                both = intersections(sets[s:e])
                linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
                _, number = np.unique(np.array(labels[s:e]), axis=0, return_inverse=True)
                number = number.ravel()
                linked &= number[:, None] < number
                root = list(range(number.max() + 1))

                def find(v: int, root=root) -> int:
                    while root[v] != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                for p, q in zip(*np.nonzero(linked), strict=True):
                    u, v = find(int(number[p])), find(int(number[q]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        x.append(s + p)
                        y.append(s + q)
            if x:
                yield pa.record_batch({"x": _structs(a[x], b[x]), "y": _structs(a[y], b[y])})

    return _blocks(members, "cluster", F.col("blocks")).mapInArrow(compare, f"x {CLASS}, y {CLASS}")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, shingles: the full set of each wanted class (doc_id, cls), read from the text of its smallest id.

    Texts aren't moved. A filter of ID_BITS bits for each wanted id, and of ID_WORDS words at most, tells which texts may be
    wanted; of their sets, those of wanted classes are kept.
    """
    words = 1 << max(10, min(ID_WORDS, max(1, wanted.count() * ID_BITS // 64)).bit_length())
    place = F.xxhash64("doc_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(place, 32), F.lit(64)).cast("int"))
    bits = np.zeros(words, np.int64)
    for r in wanted.groupBy(F.pmod(place, F.lit(words)).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[r["word"]] = r["bits"]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("place").to_numpy()
            held = (bits[h % words] >> (h >> 32) % 64) & 1 == 1
            for run in runs(batch.column("text").filter(pa.array(held))):
                rows = [(set_id(x), x) for x in shingle_sets(run) if len(x)]
                yield pa.record_batch({"cls": _structs([c[0] for c, _ in rows], [c[1] for c, _ in rows]), "shingles": pa.array([x.tobytes() for _, x in rows], pa.binary())})

    found = docs.select(place.alias("place"), "text").mapInArrow(collect, f"cls {CLASS}, shingles binary")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """x, y: links that connect the classes exactly as all pairs at or above the similarity would."""
    size = F.count("*").over(Window.partitionBy("key"))
    shared = keyed(classes, relaxed(percent)).withColumn("size", size).where("size > 1")
    shared = shared.select("key", "cls", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    members = shared.join(classes.select("cls", "n_shingles", "signature"), "cls")
    near = stored(_near_pairs(members, percent), "near").groupBy("x", "y").agg(F.min("distance").alias("distance"))
    near = stored(near, "near")

    clusters = components(near).withColumnRenamed("node", "cls").withColumnRenamed("label", "cluster")
    clusters = stored(clusters.join(classes.select("cls", "doc_id"), "cls"), "clusters")
    sets = stored(_sets(docs, clusters.select("doc_id", "cls")), "sets")

    directed = near.select(F.col("x").alias("at"), F.col("y").alias("to"), "distance").union(near.select(F.col("y"), F.col("x"), "distance"))
    first = directed.groupBy("at").agg(F.min(F.struct("distance", "to")).alias("best")).select("at", F.col("best.to").alias("to"))
    first = first.select(F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y")).distinct()
    found = stored(_confirmed(first, sets, percent), "links")

    labels = components(found).withColumnRenamed("node", "cls")
    labelled = clusters.join(labels, "cls", "left").select("cls", "cluster", F.coalesce("label", "cls").alias("label"))
    open_ = labelled.groupBy("cluster").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = open_.where("low < high").select("cluster", F.ceil(F.col("size") / SET_BLOCK).cast("long").alias("blocks"))
    rest = labelled.join(open_, "cluster").select(F.xxhash64("cluster").alias("cluster"), "cls", "label", "blocks").join(sets, "cls")
    return found.union(stored(_cluster_links(rest, percent), "links"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = stored(signed(docs), "signatures")
    classes = stored(
        rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "classes",
    )
    labels = components(links(docs, classes, percent)).withColumnRenamed("node", "cls")
    group = F.coalesce("label", "cls")
    ids = classes.join(labels, "cls", "left").select("cls", "doc_id", group.alias("label"))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = ids.join(least, "label").select("cls", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stand for their component, with their own columns; of rows with the same id, one."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    again, columns = free_name(docs, "again"), docs.columns
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias(again))
    left = docs.join(gone, "doc_id", "left_anti").join(repeated, "doc_id", "left")
    single = left.where(F.col(again).isNull()).select(columns)
    return single.union(left.where(F.col(again).isNotNull()).select(columns).dropDuplicates(["doc_id"]))
