"""Lexical retrieval packing: a window is filled with the unused neighbours of its seed document.

The terms are the vocabulary's ids. How many documents hold a term, how many documents there are and how long they
are on average is counted over all of them. Documents are dealt out by their leading terms, those of highest BM25 weight, so that
likely neighbours come together; every SHARD_DOCS documents, or SHARD_IDS ids, make a shard with an inverted index of its
own. A range of leading terms that many documents share is split by a hash, so no term makes a task of its own.

In a shard the next unused document is the seed. All its terms are looked up in the index, the unused documents are ranked by
their BM25 score, and greedily those that fit go into the window. When none fits any more, the best-ranked one is
cut: its first ids fill the window, the others seed the next one. So every window of a shard is full but for the
last; what the last holds is cut into sequences whose lengths are powers of two, which need no padding.

A document's ids are followed by one closing id. Null and empty texts have the closing id alone. Repeated rows are packed as
often as they occur, in any order among themselves. Documents beyond a window go on in the next ones. An empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .wordids import encoder

#: Documents, and ids, after which a shard is full; a longer document makes a shard alone.
SHARD_DOCS = 1024
SHARD_IDS = 1 << 21
#: BM25's saturation of repeated terms and weight of lengths.
K1 = 1.2
B = 0.75
#: Ids that a task turns into terms at once.
RUN_IDS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, closing: int) -> DataFrame:
    """doc_id, ids, n_ids of every row; ids are little-endian unsigned integers, the closing id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        last = np.array([closing], words.dtype).tobytes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [x + last for x in words([t or "" for t in part.column("text").to_pylist()])]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n_ids": pa.array([len(x) // words.width for x in ids], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary, n_ids long")


@dataclass(frozen=True)
class Terms:
    """What is known of all documents: how rare each term is, and the average length. Bounded by the vocabulary."""

    rarity: np.ndarray
    average: float

    def weights(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.rarity[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.average))


def _groups(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each distinct term of each document, by document and term."""
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    key, count = np.unique(owner * size + np.concatenate(ids), return_counts=True) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))
    return key // size, key % size, count


def _runs(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a task with their ids, in runs of about RUN_IDS ids."""
    for batch in batches:
        ids = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column("ids")]
        edges = np.cumsum([0, *(len(x) for x in ids)])
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + RUN_IDS, side="right")) - 1)
            yield batch.slice(i, j - i), ids[i:j]
            i = j


def term_statistics(tokens: DataFrame, size: int, dtype: np.dtype) -> Terms:
    """Counted over all documents: each task adds up its own, Spark the tasks'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = np.zeros(size, np.int64)
        for _, ids in _runs(batches, dtype):
            holders += np.bincount(_groups(ids, size)[1], minlength=size)
        term = np.flatnonzero(holders)
        yield pa.record_batch({"term": pa.array(term, pa.int32()), "n": pa.array(holders[term], pa.int64())})

    holders = np.zeros(size)
    for r in tokens.select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        holders[r["term"]] = r["n"]
    n, total = tokens.agg(F.count("*"), F.sum("n_ids")).first()
    return Terms(np.log1p((n - holders + 0.5) / (holders + 0.5)), (total or 0) / max(1, n))


def _heaviest(weight: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of each document's largest weight, the first of several."""
    at = np.flatnonzero(weight == np.maximum.reduceat(weight, starts)[doc])
    return at[np.searchsorted(doc[at], np.arange(len(starts)))]


def led(tokens: DataFrame, terms: Terms, dtype: np.dtype) -> DataFrame:
    """The rows with their two leading terms; the closing id, which all share, leads where there is no other."""
    size = len(terms.rarity)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _runs(batches, dtype):
            doc, term, count = _groups(ids, size)
            weight = terms.weights(term, count, np.array([len(x) for x in ids])[doc])
            starts = np.searchsorted(doc, np.arange(len(ids)))
            first = _heaviest(weight, doc, starts)
            weight[first] = -1.0  # a document of one term leads with it twice
            second = _heaviest(weight, doc, starts)
            yield pa.record_batch([*part.columns, pa.array(term[first], pa.int32()), pa.array(term[second], pa.int32())], names=[*part.schema.names, "lead", "second"])

    return tokens.mapInArrow(lead, "doc_id long, ids binary, n_ids long, lead int, second int")


class Index:
    """The inverted index of a shard: the postings of each term, with their BM25 weights."""

    def __init__(self, ids: list[np.ndarray], terms: Terms):
        size = len(terms.rarity)
        self.doc, term, count = _groups(ids, size)
        self.edges = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.posting = self.doc[order]
        self.weight = terms.weights(term, count, np.array([len(x) for x in ids])[self.doc])[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))
        self.n = len(ids)

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the terms of one of them."""
        query = self.term[self.edges[seed] : self.edges[seed + 1]]
        first, length = self.starts[query], self.starts[query + 1] - self.starts[query]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(first - ends + length, length)
        return np.bincount(self.posting[at], weights=self.weight[at], minlength=self.n)


def fill(ids: list[np.ndarray], terms: Terms, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The sequences of a shard: lists of (document, first id, number of ids)."""
    lengths = np.array([len(x) for x in ids])
    index = Index(ids, terms)
    unused = np.ones(len(ids), bool)
    seed, start = -1, 0
    while True:
        if seed < 0:
            if not unused.any():
                return
            seed, start = int(unused.argmax()), 0
            unused[seed] = False
        take = min(window, int(lengths[seed]) - start)
        sequence, room, source, seed_start = [(seed, start, take)], window - take, seed, start
        seed, start = (seed, seed_start + take) if seed_start + take < lengths[seed] else (-1, 0)
        if room and unused.any():
            left = np.flatnonzero(unused)
            order = left[np.argsort(-index.scores(source)[left], kind="stable")]
            need = lengths[order]
            while room and len(order):
                fits = int((need <= room).argmax())
                if need[fits] <= room:
                    at, take = int(order[fits]), int(need[fits])
                    order, need = np.delete(order, fits), np.delete(need, fits)
                else:
                    at, take = int(order[0]), room
                    seed, start, order = at, take, order[:0]
                unused[at] = False
                sequence.append((at, 0, take))
                room -= take
        if room:
            yield from _powers_of_two(sequence)
        else:
            yield sequence


def _powers_of_two(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence cut into ones whose lengths are falling powers of two."""
    total = sum(take for _, _, take in sequence)
    rest = list(reversed(sequence))
    for k in range(total.bit_length() - 1, -1, -1):
        if not total >> k & 1:
            continue
        out, room = [], 1 << k
        while room:
            doc, start, take = rest.pop()
            used = min(room, take)
            out.append((doc, start, used))
            room -= used
            if used < take:
                rest.append((doc, start + used, take - used))
        yield out


def pack(rows: DataFrame, terms: Terms, dtype: np.dtype, window: int) -> DataFrame:
    """The pieces of led rows. A task goes through its range shard by shard and holds one of them."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        doc_ids, ids, total = [], [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(x.as_py(), dtype))
                total += len(ids[-1])
                if len(ids) >= SHARD_DOCS or total >= SHARD_IDS:
                    yield doc_ids, ids
                    doc_ids, ids, total = [], [], 0
        if ids:
            yield doc_ids, ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for doc_ids, ids in shards(batches):
            out: list[tuple] = []
            for sequence in fill(ids, terms, window):
                offset = 0
                for doc, start, take in sequence:
                    piece = ids[doc][start : start + take].astype("<u4").tobytes()
                    out.append((doc_ids[doc], start, take, zlib.crc32(piece), len(ids[doc]), number, offset))
                    offset += take
                number += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    keys = ["lead", "second", F.xxhash64("doc_id", "ids"), "doc_id"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.select("doc_id", "ids").mapInArrow(place, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, closing: int, window: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    words = encoder(tokenizer)
    tokens = stored(tokenised(docs, tokenizer, closing), "tokens")
    terms = term_statistics(tokens, max(words.size, closing + 1), words.dtype)
    return pack(led(tokens, terms, words.dtype), terms, words.dtype, window)
