"""Gradient-boosted trees for yes/no labels, in numpy, over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: float = 10.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.edges: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.model = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, 255, np.int64)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-6)
                for j in range(b.shape[1]):
                    place = (node - first) * self.bins + b[:, j]
                    sg = np.bincount(place, g, n * self.bins).reshape(n, self.bins).cumsum(axis=1)
                    sh = np.bincount(place, h, n * self.bins).reshape(n, self.bins).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.leaf) + (tg - sg) ** 2 / (th - sh + self.leaf) - tg**2 / (th + self.leaf)
                    at = gain.argmax(axis=1)
                    own = gain[np.arange(n), at]
                    better = own > best
                    best[better] = own[better]
                    feature[first : first + n][better], cut[first : first + n][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.leaf)
            self.model.append((feature, cut, value))
            score += value[leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        # Features by row, so that a tree's look-ups lie side by side.
        b, out = np.ascontiguousarray(self.binned(x).T), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.model:
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[feature[node], rows] > cut[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out
