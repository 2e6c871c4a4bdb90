"""Whitening of embeddings by shifted CholeskyQR: three distributed Gram passes, composed factors, a small SVD.

An entry c becomes the integer x = floor(256 c). The fit list is each distinct vector once: n vectors, sums S.
Rows of the centred fit list A are orthogonalised again and again: a pass gathers the Gram matrix of the rows as they
are, G = QᵀQ, its Cholesky factor R turns them into Q R⁻¹ by triangular solves in the tasks of the next pass. The first
factor is of G with a small shift, so that nearly dependent dimensions don't break it; two more passes
restore what the shift took. A = Q (R3 R2 R1), and the right singular vectors of the small product are the
components, its squared singular values over n their variances. A Gram matrix that has no Cholesky
factor, as dimensions depend on each other, gives its symmetric root instead, which composes in the same way.

The driver holds matrices of dimensions x dimensions and one sum per dimension, nothing that grows with the rows.

Rows whose vector is null or holds a null or non-finite entry are dropped, and so are rows of another length than
the most frequent one (of several, the longest). Repeated vectors count once in the fit and are all returned. Components without
variance aren't returned: all rows alike, or a single row, give no rows, as does an empty table. ``deviation`` is null
where it exceeds a long. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

SCALE = 256
PASSES = 3
#: Rows that a task turns at once.
CHUNK = 4096
#: A component is returned if its variance is at least this share of the largest one.
LEAST = 1e-12
_UNIT = 2.0**-53


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x: the usable rows with their integer vectors, all of the most frequent length."""
    entry = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(entry(v)) | (F.abs(entry(v)) == float("inf")))
    rows = table.where(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda v: F.floor(entry(v) * SCALE)).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch, d) if batch.num_rows else np.empty((0, d), np.int64)
        yield from (x[i : i + CHUNK] for i in range(0, len(x), CHUNK))


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * d, [0] * d
        for x in _chunks(batches, d):
            n += len(x)
            # halves of 32 bits, whose sums over a chunk fit 64 bits
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist(), strict=True)]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.record_batch({"dim": pa.array(range(-1, d), pa.int32()), "high": pa.array([0, *high], pa.int64()), "low": pa.array([n, *low], pa.int64())})

    parts = vectors.select("x").mapInArrow(add, "dim int, high long, low long")
    total = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


def right_solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, by substitution from the first column on."""
    out = np.empty_like(rows)
    for j in range(upper.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(vectors: DataFrame, mean: np.ndarray, turn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The Gram matrix of the centred rows after ``turn``, which makes ``width`` columns of them.

    Each task sums its own rows; of these matrices, Spark adds the entries up.
    """
    d = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _chunks(batches, d):
            rows = turn(x - mean)
            total += rows.T @ rows
        i, j = np.triu_indices(width)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    out = np.zeros((width, width))
    for r in vectors.select("x").mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def factor(g: np.ndarray, shift: float) -> tuple[np.ndarray, bool]:
    """R with RᵀR = g + shift I, and whether it is triangular; the symmetric root where there is no Cholesky factor."""
    try:
        return np.linalg.cholesky(g + shift * np.eye(len(g))).T, True
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(g)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T, False


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    #: One column per component, by falling variance; the entry of largest size is positive.
    components: np.ndarray
    variances: np.ndarray
    #: Sum of the variances of all components.
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


def fit(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """The whitening of a table of distinct integer vectors (x); None without rows or without variance."""
    head = vectors.select(F.size("x")).first()
    if head is None:
        return None
    d = head[0]
    n, total = sums(vectors, d)
    mean = np.array([float(Fraction(s, n)) for s in total])
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    trace = 0.0
    for k in range(PASSES):
        steps = list(factors)

        def turn(rows: np.ndarray, steps=steps) -> np.ndarray:
            for r in steps:
                rows = right_solve(rows, r)
            return rows

        g = gram(vectors, mean, turn, d)
        if k == 0:
            trace = float(np.trace(g))
            if not trace > 0:
                return None
        norm = float(np.linalg.norm(g, 2))
        # the shift of shifted CholeskyQR in the first pass; later ones only get one if a dimension has no length of its own
        lean = k < PASSES - 1 and np.linalg.eigvalsh(g)[0] < 1e-10 * norm
        shift = 11 * (n * d + d * (d + 1)) * _UNIT * norm if k == 0 else 1e-10 * norm if lean else 0.0
        r, triangular = factor(g, min(shift, norm))
        composed = r @ composed
        if not triangular:
            break
        factors.append(r)
    _, values, axes = np.linalg.svd(composed)
    variances = values**2 / n
    keep = variances >= LEAST * variances[0]
    axes, variances = axes[keep][:components].T, variances[keep][:components]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    return Whitening(n, total, axes, variances, trace / n)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest entry, in size, of the whitened fit list's covariance minus the identity."""
    scaled = w.scaled
    covariance = gram(vectors, w.mean, lambda rows: rows @ scaled, scaled.shape[1]) / w.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """For each row, the exact sum over dimensions of (n x - S)²; None beyond a long."""
    rough = ((x.astype(np.float64) * n - np.array(totals, np.float64)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    small = rough < 2.0**62
    if all(abs(s) < 2**62 for s in totals) and small.any():
        exact = ((x[small] * n - np.array(totals, np.int64)) ** 2).sum(axis=1)
        for i, v in zip(np.flatnonzero(small).tolist(), exact.tolist(), strict=True):
            out[i] = v
    for i in np.flatnonzero(~small | (np.array([v is None for v in out], bool))).tolist():
        value = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), totals, strict=True))
        out[i] = value if value < 2**63 else None
    return out


def apply(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component."""
    mean, scaled, n, totals = w.mean, w.scaled, w.n, w.sums
    d, width = scaled.shape
    explained = w.variances / w.total
    kind = rows.schema["vec_id"].dataType.simpleString()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, CHUNK) for i in range(0, batch.num_rows, CHUNK)):
                x = _matrix(part, d)
                m = len(x)
                owner = np.repeat(np.arange(m), width)
                yield pa.record_batch(
                    {
                        "vec_id": part.column("vec_id").take(pa.array(owner)),
                        "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * width, n, np.int64)),
                        "deviation": pa.array(deviations(x, n, totals), pa.int64()).take(pa.array(owner)),
                        "whitened": pa.array(((x - mean) @ scaled).ravel()),
                        "explained": pa.array(np.tile(explained, m)),
                        "identity_error": pa.array(np.full(m * width, error)),
                    }
                )

    return rows.select("vec_id", "x").mapInArrow(turn, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every usable row of the table, whitened: a row per row and component."""
    rows = integer_vectors(table, vec_id, vector)
    distinct = stored(rows.select("x").distinct(), "fit")
    w = fit(distinct, components)
    if w is None:
        empty = Whitening(1, [], np.zeros((0, 0)), np.zeros(0), 1.0)
        return apply(rows.limit(0), empty, 0.0)
    return apply(rows, w, identity_error(distinct, w))
