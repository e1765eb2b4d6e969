"""Gradient-boosted trees for two classes on binned features, in arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of a fixed depth, each node splitting on a feature's bin; leaves add up to log-odds."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, smooth: float = 1.0) -> None:
        self.count, self.depth, self.rate, self.smooth = trees, depth, rate, smooth

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, quantiles)) for column in x.T]
        binned = self._bin(x)
        score = np.zeros(len(y))
        leaves = 1 << self.depth
        self.feature = np.zeros((self.count, leaves), np.int64)
        self.cut = np.full((self.count, leaves), BINS, np.int64)
        self.leaf = np.zeros((self.count, leaves))
        flat = binned + np.arange(x.shape[1]) * BINS
        for t in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.ones(len(y), np.int64)
            for level in range(self.depth):
                for n in range(1 << level, 2 << level):
                    rows = np.flatnonzero(node == n)
                    if len(rows) < 8:
                        node[rows] *= 2
                        continue
                    size = x.shape[1] * BINS
                    keys = flat[rows].ravel()
                    gs = np.bincount(keys, np.repeat(g[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(1)
                    hs = np.bincount(keys, np.repeat(h[rows], x.shape[1]), size).reshape(-1, BINS).cumsum(1)
                    gain = gs**2 / (hs + self.smooth) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.smooth)
                    best = int(np.argmax(gain))
                    if gain.flat[best] > 1e-6:
                        self.feature[t, n], self.cut[t, n] = divmod(best, BINS)
                    node[rows] = 2 * n + (binned[rows, self.feature[t, n]] > self.cut[t, n])
            node -= leaves
            value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.smooth)
            self.leaf[t] = self.rate * value
            score += self.leaf[t][node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        score = np.zeros(len(x))
        for t in range(self.count):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (binned[rows, self.feature[t][node]] > self.cut[t][node])
            score += self.leaf[t][node - (1 << self.depth)]
        return score
