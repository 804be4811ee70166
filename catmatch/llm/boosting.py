"""Histogram gradient-boosted trees for two classes, and their traversal as flat arrays.

Features are cut into bins once; a split is found from sums of gradients per bin. Trees are
kept as arrays of one length per level order: feature, bin, left child and value; scoring walks
all rows through all trees at once.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    cuts: np.ndarray  # features x (bins - 1): upper bounds of bins
    feature: np.ndarray  # trees x nodes; -1: leaf
    split: np.ndarray  # trees x nodes: bins up to it go left
    value: np.ndarray  # trees x nodes
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, column, side="left") for cuts, column in zip(self.cuts, x.T)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row of x. Children of node i are 2 i + 1 and 2 i + 2."""
        total = np.full(len(x), self.start)
        if not len(x):
            return total
        binned = self.bins(x)
        rows = np.arange(len(x))
        for feature, split, value in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                inner = feature[node] >= 0
                right = binned[rows, np.maximum(feature[node], 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
        ridge: float = 2.0, least_rows: int = 5) -> Forest:
    """Logistic loss, Newton leaves. Without rows of both classes the forest says the share alone."""
    n, m = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(share / (1 - share)))
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = np.quantile(x, quantiles, axis=0).T if n else np.zeros((m, bins - 1))
    size = 2 ** (depth + 1) - 1
    feature = np.full((trees, size), -1)
    split = np.zeros((trees, size), np.int64)
    value = np.zeros((trees, size))
    forest = Forest(cuts, feature, split, value, start)
    if not 0 < y.sum() < n:
        return forest
    binned = forest.bins(x).astype(np.int64)
    flat = binned + np.arange(m) * bins
    total = np.full(n, start)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for at in range(2 ** depth - 1):
            rows = np.flatnonzero(node == at)
            if len(rows) < 2 * least_rows:
                continue
            where = flat[rows].ravel()
            sums = [np.bincount(where, np.repeat(w[rows], m), m * bins).reshape(m, bins).cumsum(1)[:, :-1]
                    for w in (gradient, weight, np.ones(n))]
            g, h, c = gradient[rows].sum(), weight[rows].sum(), len(rows)
            gain = sums[0] ** 2 / (sums[1] + ridge) + (g - sums[0]) ** 2 / (h - sums[1] + ridge) - g * g / (h + ridge)
            gain[(sums[2] < least_rows) | (c - sums[2] < least_rows)] = 0
            best = int(gain.argmax())
            if gain.flat[best] > 1e-6:
                feature[tree, at], split[tree, at] = divmod(best, bins - 1)
                node[rows] = 2 * at + 1 + (binned[rows, feature[tree, at]] > split[tree, at])
        g, h = np.bincount(node, gradient, size), np.bincount(node, weight, size)
        value[tree] = rate * g / (h + ridge)
        total += value[tree][node]
    return forest
