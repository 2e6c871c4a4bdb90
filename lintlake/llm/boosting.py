"""Histogram gradient-boosted trees in numpy, for small training sets; flat arrays for scoring.

Splits are searched over at most ``bins`` cut values per feature; a tree is grown level by level.
Rows may carry weights. Equal gains go to the lower feature, then to the lower cut, so equal
inputs give equal trees. Missing values are read as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees as flat arrays: node i of tree t sits at t * width + i, its children at 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    width: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values per row (log odds)."""
        x = np.nan_to_num(np.asarray(x, np.float64), posinf=1e300, neginf=-1e300)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in range(0, len(self.feature), self.width):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = root + node
                node = 2 * node + 1 + (x[rows, self.feature[at]] > self.cut[at])
            out += self.value[root + node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x, y, weight=None, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boosted trees for labels 0/1. With no rows, or one label only, the trees give that share everywhere."""
    x = np.nan_to_num(np.asarray(x, np.float64), posinf=1e300, neginf=-1e300)
    y = np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    n, k = x.shape
    share = (w @ y + 0.5) / (w.sum() + 1.0)
    base = float(np.log(share / (1 - share)))
    width = 2 ** (depth + 1) - 1
    if n == 0 or len(np.unique(y)) < 2:
        return Trees(np.zeros(width, np.int64), np.full(width, np.inf), np.zeros(width), depth, width, base)
    cuts, code = [], np.empty((k, n), np.int64)
    for f in range(k):
        seen = np.unique(x[:, f])
        middle = (seen[1:] + seen[:-1]) / 2
        if len(middle) >= bins:
            middle = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(middle)
        code[f] = np.searchsorted(middle, x[:, f], side="left")
    size = max(len(c) for c in cuts) + 1
    out = Trees(np.zeros(trees * width, np.int64), np.full(trees * width, np.inf), np.zeros(trees * width), depth, width, base)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            feature, split = np.zeros(count, np.int64), np.full(count, size)
            for f in range(k):
                if not len(cuts[f]):
                    continue
                at = local * size + code[f]
                gs, hs, ws = (np.cumsum(np.bincount(at, v, count * size).reshape(count, size), axis=1) for v in (g, h, w))
                gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[(ws < least) | (ws[:, -1:] - ws < least)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best + 1e-9
                best[better], feature[better], split[better] = value[better], f, top[better]
            at = t * width + first + np.arange(count)
            out.feature[at] = feature
            out.cut[at] = [cuts[f][s] if s < len(cuts[f]) else np.inf for f, s in zip(feature, split, strict=True)]
            node = 2 * node + 1 + (code[feature[local], np.arange(n)] > split[local])
        leaf = 2**depth - 1
        gs, hs = (np.bincount(node - leaf, v, 2**depth) for v in (g, h))
        values = rate * gs / (hs + ridge)
        out.value[t * width + leaf : (t + 1) * width] = values
        score += values[node - leaf]
    return out
