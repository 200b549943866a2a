"""Small boosted regression trees in numpy, for one model a key inside a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Histogram bins of a feature.
BINS = 32


@dataclass
class Boosted:
    """Sum of trees of equal depth: level by level, nodes hold a feature and a bin edge to go right from."""

    base: float
    rate: float
    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = bin_of(x, self.edges)
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            out += self.rate * leaf[node - len(feature)]
        return out


def bin_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.1, ridge: float = 1.0) -> Boosted:
    """Least-squares boosting: each tree's splits gain most in sum(r)^2 / (n + ridge) over histograms of the rest r, the first feature and edge
    on ties; leaves are sum(r) / (n + ridge)."""
    width, nodes = x.shape[1], (1 << depth) - 1
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    at = bin_of(x, edges) + np.arange(width) * BINS
    base = float(y.mean())
    rest, row = y - base, np.arange(len(y))
    # the root's bins and counts are those of every tree
    root = at.ravel()
    root_count = np.bincount(root, minlength=width * BINS).reshape(1, width, BINS).cumsum(2)
    features, cuts, leaves = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), BINS), np.zeros((trees, nodes + 1))
    for t in range(trees):
        node, weight = np.zeros(len(y), np.int64), np.repeat(rest, width)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (width * BINS) + at).ravel() if level else root
            total = np.bincount(flat, weight, n * width * BINS).reshape(n, width, BINS).cumsum(2)
            count = np.bincount(flat, minlength=n * width * BINS).reshape(n, width, BINS).cumsum(2) if level else root_count
            all_r, all_n = total[:, :1, -1:], count[:, :1, -1:]
            gain = total**2 / (count + ridge) + (all_r - total) ** 2 / (all_n - count + ridge)
            gain[(count == 0) | (count == all_n)] = -1
            best = gain.reshape(n, -1).argmax(1)
            splits = gain.reshape(n, -1)[np.arange(n), best] > 0
            features[t, first : first + n] = best // BINS
            cuts[t, first : first + n] = np.where(splits, best % BINS, BINS)
            f = features[t][node]
            node = 2 * node + 1 + (at[row, f] - f * BINS > cuts[t][node])
        leaf = node - nodes
        sums, sizes = np.bincount(leaf, rest, nodes + 1), np.bincount(leaf, minlength=nodes + 1)
        leaves[t] = sums / (sizes + ridge)
        rest = rest - rate * leaves[t][leaf]
    return Boosted(base, rate, edges, features, cuts, leaves)
