"""Gradient-boosted regression trees over dense features, and isotonic calibration, in numpy.

Training data is a bounded sample by contract, so it fits the driver; scoring is vectorised in the workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A tree in arrays: at node i go left if x[feature] <= cut, else right; a leaf has feature -1."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("value", value)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut, left, right, value = (np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        return value[at]


@dataclass
class Boosted:
    """Logistic boosting with second-order leaf values over quantile bins."""

    trees_wanted: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    least_weight: float = 1.0
    start: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.trees_wanted):
            p = 1 / (1 + np.exp(-margin))
            tree = Tree()
            self._grow(tree, binned, edges, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            margin += tree.predict(x)
        return self

    def _grow(self, tree: Tree, binned, edges, g, h, rows, level: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        node = tree.add(float(-self.rate * total_g / (total_h + self.ridge)))
        if level == self.depth:
            return node
        best = (1e-6, -1, 0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            left_g = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[(left_h < self.least_weight) | (right_h < self.least_weight)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            goes = binned[rows, f] <= k
            tree.feature[node], tree.cut[node] = f, float(edges[f][k])
            tree.left[node] = self._grow(tree, binned, edges, g, h, rows[goes], level + 1)
            tree.right[node] = self._grow(tree, binned, edges, g, h, rows[~goes], level + 1)
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.predict(x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators), to be interpolated."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    points, first = np.unique(score[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    counts = np.diff(np.append(first, len(y))).astype(float)
    blocks: list[list[float]] = []
    for s, c, x in zip(sums, counts, points):
        blocks.append([s, c, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, _, hi = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += c2
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, c, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [s / c] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)
