"""Gradient-boosted regression trees for a two-class label, in numpy: binned features, logistic loss, Newton leaves."""

from __future__ import annotations

import numpy as np

BINS = 16


class BoostedTrees:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, least: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.l2 = trees, depth, rate, least, l2
        self.cuts, self.forest, self.start = [], [], 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b, mean = self._binned(x), np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            tree: list[tuple] = []
            z += self._grow(tree, b, y - p, p * (1 - p), np.arange(len(y)), 0, np.zeros(len(y)))
            self.forest.append(tree)
        return self

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, level: int, out: np.ndarray) -> np.ndarray:
        """tree: (feature, bin, left, right) or (None, value)."""
        me, best = len(tree), (1e-6, None, None)
        tree.append(())
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if level < self.depth and len(rows) >= 2 * self.least:
            for j in range(b.shape[1]):
                if not len(self.cuts[j]):
                    continue
                k = len(self.cuts[j]) + 1
                c = b[rows, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
                if gain.max() > best[0]:
                    best = float(gain.max()), j, int(gain.argmax())
        if best[1] is None:
            tree[me] = (None, float(self.rate * total_g / (total_h + self.l2)))
            out[rows] = tree[me][1]
            return out
        _, j, cut = best
        go = b[rows, j] <= cut
        left = len(tree)
        self._grow(tree, b, g, h, rows[go], level + 1, out)
        right = len(tree)
        self._grow(tree, b, g, h, rows[~go], level + 1, out)
        tree[me] = (j, cut, left, right)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        b, z = self._binned(x), np.full(len(x), self.start)
        for tree in self.forest:
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, rows = stack.pop()
                node = tree[k]
                if node[0] is None:
                    z[rows] += node[1]
                elif len(rows):
                    go = b[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[go]), (node[3], rows[~go])]
        return 1 / (1 + np.exp(-z))
