"""Histogram gradient-boosted trees for a binary label: fitting on a driver-sized sample, and traversal in whole arrays.

Trees are complete to a fixed depth and kept as flat arrays, a row a tree: the children of node k are 2k + 1 and 2k + 2. A node that
is not split sends all rows left. Traversal steps all rows and trees down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The probability of label 1 for each row of ``x``; NaN counts as low."""
        out = np.empty(len(x))
        trees, depth = np.arange(len(self.feature)), int(np.log2(self.value.shape[1]))
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            own = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[own, self.feature[trees, node]] > self.threshold[trees, node])
            margin = self.base + self.value[trees, node - (self.value.shape[1] - 1)].sum(axis=1)
            out[at : at + rows] = 1 / (1 + np.exp(-margin))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost on the log loss. A sample of one class, or none, gives a constant."""
    inner, leaves, n = 2**depth - 1, 2**depth, len(y)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n < 2 * least or not 0 < y.sum() < n:
        return Trees(feature, threshold, value, base)
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(features)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(features)], axis=1)
    cell = binned + np.arange(features) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, many = 2**d - 1, 2**d
            at = ((node - first)[:, None] * (features * bins) + cell).ravel()
            shape = (many, features, bins)
            gs = np.bincount(at, np.repeat(g, features), many * features * bins).reshape(shape)
            hs = np.bincount(at, np.repeat(h, features), many * features * bins).reshape(shape)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, base)
