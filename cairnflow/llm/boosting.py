"""Gradient-boosted trees for a two-class label, and isotonic calibration. Fitted on a bounded sample of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full tree: node i has children 2i + 1 and 2i + 2; feature -1 ends the path."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                return self.value[node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(go, 2 * node + 1 + right, node)


class Boosting:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list[Tree] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        n, m = x.shape
        rate = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        raw = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(codes, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree.predict(x)
        return self

    def _grow(self, codes, cuts, grad, hess) -> Tree:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(grad))}
        while rows:
            node, at = rows.popitem()
            g, h = grad[at].sum(), hess[at].sum()
            value[node] = -self.rate * g / (h + self.ridge)
            if 2 * node + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(codes[at, j], grad[at], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[at, j], hess[at], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(hl < self.least) | (h - hl < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                _, j, k = best
                feature[node], cut[node] = j, cuts[j][k]
                right = codes[at, j] > k
                rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]
        return Tree(feature, cut, value)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels (pool adjacent violators), between its steps linear.

    A small part of the uncalibrated probability is mixed in, so that rows on one step keep their order."""

    MIXED = 1e-3

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum, weight, lowest and highest raw value
        for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, r, r])
            while len(blocks) > 1 and (
                blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]
            ):
                s, w, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
        self.at = np.array([x for b in blocks for x in b[2:]])
        self.level = np.array([x for b in blocks for x in [b[0] / b[1]] * 2])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        plain = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
        level = np.interp(raw, self.at, self.level) if len(self.at) else plain
        return (1 - self.MIXED) * level + self.MIXED * plain
