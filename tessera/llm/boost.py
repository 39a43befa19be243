"""Gradient-boosted trees for a yes-or-no label, on features cut into bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth: ``feature`` and ``limit`` of inner nodes in heap order, ``value`` of leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of yes for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        depth = inner.bit_length()
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - inner]
        return total


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None, rows: float = 0.25, seed: int = 5) -> Forest:
    """Newton boosting of the logistic loss; each level of a tree is grown by one histogram over all features.

    Every tree is grown on a random share ``rows`` of the rows.
    """
    random = np.random.default_rng(seed)
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, base), (1 << depth) - 1
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    columns = np.arange(f)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        part = np.flatnonzero(random.random(n) < rows) if rows < 1 else np.arange(n)
        part_x, part_codes, part_g, part_h = x[part], codes[part], np.repeat(g[part], f), np.repeat(h[part], f)
        at = np.zeros(len(part), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = (((at - first)[:, None] * f + columns) * bins + part_codes).ravel()
            size = count * f * bins
            gs = np.bincount(cell, part_g, size).reshape(count, f, bins).cumsum(axis=2)
            hs = np.bincount(cell, part_h, size).reshape(count, f, bins).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            feature, cut = best // bins, best % bins
            for k in range(count):
                if gain[k, feature[k], cut[k]] > 1e-9:
                    forest.feature[t, first + k] = feature[k]
                    forest.limit[t, first + k] = edges[feature[k]][cut[k]]
            at = 2 * at + 1 + (part_x[np.arange(len(part)), forest.feature[t, at]] > forest.limit[t, at])
        at = np.zeros(n, np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[np.arange(n), forest.feature[t, at]] > forest.limit[t, at])
        leaf = at - inner
        forest.value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += forest.value[t][leaf]
    return forest
