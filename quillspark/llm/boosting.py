"""Gradient-boosted trees on binned features and isotonic calibration, in numpy; small enough to train on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, depth-limited trees grown level by level on at most 32 quantile bins a feature."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least_hess: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least_hess, self.ridge = trees, depth, rate, bins, least_hess, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        binned = self._bin(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        self.splits, self.leaves = [], []
        z = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            split = []
            for level in range(self.depth):
                size = 1 << level
                best = np.full(size, 1e-9)
                feature, at = np.zeros(size, dtype=np.int64), np.full(size, self.bins)
                all_g, all_h = np.bincount(node, g, size), np.bincount(node, h, size)
                for f in range(m):
                    key = node * self.bins + binned[:, f]
                    left_g = np.bincount(key, g, size * self.bins).reshape(size, -1).cumsum(1)
                    left_h = np.bincount(key, h, size * self.bins).reshape(size, -1).cumsum(1)
                    right_g, right_h = all_g[:, None] - left_g, all_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - (all_g**2 / (all_h + self.ridge))[:, None]
                    gain[(left_h < self.least_hess) | (right_h < self.least_hess)] = -1
                    cut = gain.argmax(1)
                    better = gain[np.arange(size), cut] > best
                    best[better], feature[better], at[better] = gain[np.arange(size), cut][better], f, cut[better]
                split.append((feature, at))
                node = node * 2 + (binned[np.arange(n), feature[node]] > at[node])
            size = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            self.splits.append(split)
            self.leaves.append(leaf)
            z += leaf[node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for split, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for feature, at in split:
                node = node * 2 + (binned[rows, feature[node]] > at[node])
            z += leaf[node]
        return 1 / (1 + np.exp(-z))


class Isotonic:
    """The non-decreasing step function nearest to labels in squares (pool adjacent violators), read by interpolation."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        at, first, n = np.unique(x[order], return_index=True, return_counts=True)
        total = np.add.reduceat(y[order].astype(float), first)
        pools: list[list[float]] = []  # [sum, count, least x, greatest x]
        for v, s, c in zip(at, total, n, strict=True):
            pools.append([s, c, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s2, c2, _, hi = pools.pop()
                pools[-1][0] += s2
                pools[-1][1] += c2
                pools[-1][3] = hi
        self.x = np.array([v for p in pools for v in (p[2], p[3])])
        self.y = np.array([p[0] / p[1] for p in pools for _ in (0, 1)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
