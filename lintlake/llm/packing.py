"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

A document's ids are those of the tokenizer and a closing 0. A longer document is cut into pieces of
the capacity, of which the first may be shorter. Pieces are packed by their length alone, so
the plan is made on the counts of lengths (at most ``tokens`` of them), not on the pieces:
lengths in falling order, and each into the open kind of sequence that vector best fit
selects under all capacities. Spark then numbers the pieces of a length and deals them to the places.

Null and empty texts have the id 0 alone. Repeated rows are packed as often as they occur. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .wordids import byte_ranks

#: How byte-level vocabularies of this kind part a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents, and attention cost (sum of squared lengths).

    The defaults of the last two are the largest values that ``tokens`` allows.
    """

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048


class ByteIds:
    """Ids of texts under a byte-level vocabulary: the file's merges by rank, which tiktoken's core does in one pass.

    Nothing is remembered from text to text. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=byte_ranks(vocabulary, None), special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.array(self.core.encode_ordinary(t), "<u4").tobytes() for t in texts]


_encoders: dict[str, ByteIds] = {}


def pieces(docs: DataFrame, tokenizer: str, tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``tokenizer`` is a file that every machine has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ByteIds(tokenizer)
        encode = _encoders[tokenizer]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    first = (n - 1) % tokens + 1
                    edges = [0, *range(first, n + 1, tokens)]
                    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        out.append((doc_id, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j])))
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: Capacity, score: str = "dot") -> list[tuple[int, int, int, int, int]]:
    """Places for the pieces: (length, first rank, last rank + 1, first sequence, offset).

    The pieces of a length with ranks first.. go one each to the sequences from the first on, at that
    offset. Sequences with equal contents are one kind, so the work follows the number of
    lengths. ``score`` selects among the kinds that a piece fits under every capacity: "dot" takes the
    smallest dot product of demand and residual, both as shares of the capacities and weighted by
    the total demand; "norm" takes the smallest weighted norm of what would be left. Ties go to the fuller kind.
    Pieces come in falling length, so the smallest product, the least room for a piece of this shape, is the best fit; the
    largest one would spread the pieces over the emptiest sequences.
    """
    limit = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    lengths = sorted(counts, reverse=True)
    total = sum(np.array([x, 1, x * x], np.float64) * counts[x] for x in lengths) / limit if lengths else np.ones(3)
    weight = total / total.sum()
    residual = np.zeros((0, 3))
    room = np.zeros(0, np.int64)
    contents: list[tuple[int, ...]] = []
    by_contents: dict[tuple[int, ...], int] = {}

    def put(kind: tuple[int, ...], left: np.ndarray, n: int) -> None:
        nonlocal residual, room
        if kind in by_contents:
            room[by_contents[kind]] += n
            return
        by_contents[kind] = len(contents)
        contents.append(kind)
        residual, room = np.vstack([residual, left]), np.append(room, n)

    for length in lengths:
        need, left = np.array([length, 1, length * length], np.float64), counts[length]
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room > 0) & (residual >= need).all(axis=1))
            if len(fits):
                share = residual[fits] / limit
                after = share - need / limit
                value = -(after**2 @ weight) if score == "norm" else -((share * (need / limit)) @ weight)
                best = int(fits[np.lexsort((after[:, 0], -value))[0]])
                n = min(left, int(room[best]))
                room[best] -= n
                put((*contents[best], length), residual[best] - need, n)
            else:
                whole = max(1, int(min(limit // need)))
                n = left // whole if left >= whole else 1
                kind = (length,) * (whole if left >= whole else left)
                put(kind, limit - need * len(kind), n)
                left -= n * len(kind)
                continue
            left -= n
    places, rank, sequence = [], dict.fromkeys(lengths, 0), 0
    for kind, n in zip(contents, room.tolist(), strict=True):
        if not n:
            continue
        offset = 0
        for length in kind:
            places.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return places


def pack(parts: DataFrame, capacity: Capacity, score: str = "dot") -> DataFrame:
    """The pieces with sequence_id and offset.

    What the driver holds are the counts of lengths and the places, both bounded by the capacity.
    Ranks within a length are counted in salted groups, so that a frequent length is no single group.
    """
    spark = parts.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = stored(parts.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, capacity, score)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = parts.withColumn("own", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*[c for c in parts.columns if c != "salt"], (F.col("own") + F.col("base")).alias("rank"))

    places.sort()
    table = np.array(places, np.int64).reshape(-1, 5)
    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(capacity.tokens + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                rows, lo, hi = length == x, first[x], first[x + 1]
                at[rows] = lo + np.searchsorted(table[lo:hi, 1], rank[rows], side="right") - 1
            columns = [batch.column(c) for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=[*[c for c in names if c != "rank"], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), score: str = "dot") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(docs, tokenizer, capacity.tokens), "pieces"), capacity, score)
