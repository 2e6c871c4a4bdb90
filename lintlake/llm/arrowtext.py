"""Words, hashes and counts of whole texts, worked out on Arrow buffers.

Texts arrive in Arrow batches and are handled in runs of about ``RUN_BYTES``, so a task holds
one run of arrays whatever the batch size; a single longer text makes a run of its own.
A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
#: Bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(step: np.uint64, n: int) -> np.ndarray:
    """step**0 .. step**(n-1) modulo 2**64."""
    have = _powers.get(int(step))
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), step, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * RUN_BYTES:
            _powers[int(step)] = have
    return have[:n]


class Run:
    """Consecutive texts of a batch as one byte array; word positions are found on first use."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._words = None

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the first word of each text (n + 1 values)."""
        if self._words is None:
            inside = ~SPACE[self.data]
            start, end = inside.copy(), inside.copy()
            if len(inside):
                start[1:] &= ~inside[:-1]
                end[:-1] &= ~inside[1:]
                full = self.offsets[:-1] < self.offsets[1:]
                at = self.offsets[:-1][full]
                start[at] = inside[at]
                at = self.offsets[1:][full] - 1
                end[at] = inside[at]
            starts = np.flatnonzero(start)
            self._words = starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)
        return self._words

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased on request."""
        starts, ends, _ = self.words
        out = np.empty(len(starts), np.uint64)
        values = _BYTE_VALUES[LOWER] if lower else _BYTE_VALUES
        i = 0
        while i < len(starts):  # once, but for very long texts
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * RUN_BYTES)))
            out[i:j] = span_hashes(values[self.data[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j
        return out

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are marked."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end) of a sequence of 64-bit values, equal for equal spans."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_STEP, len(values)), out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * powers(_BACK, len(values) + 1)[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values, in order; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return span_hashes(hashes, at, at + k)


def windows_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of k words over a run: which lie within one text, and which text that is."""
    n = max(0, int(first[-1]) - k + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return (owner[:n] == owner[k - 1 : k - 1 + n]) if n else np.zeros(0, bool), owner[:n]


def runs(column: pa.Array | pa.ChunkedArray) -> Iterator[Run]:
    """The texts of a column in runs of about RUN_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        for chunk_start, chunk in _chunks(column):
            yield from _runs(chunk, chunk_start)
    else:
        yield from _runs(column, 0)


def _chunks(column: pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for chunk in column.chunks:
        yield at, chunk
        at += len(chunk)


def _runs(column: pa.Array, base: int) -> Iterator[Run]:
    if not len(column):
        return
    if column.null_count or not pa.types.is_string(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    wide = pa.types.is_large_string(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, side="right")) - 1)
        yield Run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], base + i)
        i = j


def binary(values: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([v.tobytes() for v in values], pa.binary())
