"""Regularised linear text models over hashed features, in numpy."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def row_means(weights: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean weight vector of each row's features; 0 for rows without features."""
    out = np.zeros((len(rows) - 1, weights.shape[1]), np.float32)
    n = np.diff(rows)
    some = np.flatnonzero(n > 0)
    step = 1 << 14
    for i in range(0, len(some), step):
        own = some[i : i + step]
        lo, hi = rows[own[0]], rows[own[-1] + 1]
        out[own] = np.add.reduceat(weights[ids[lo:hi]], rows[own] - lo, axis=0) / n[own][:, None]
    return out


class MeanModel:
    """Softmax over the mean of feature weights, fitted by Adagrad with an L2 penalty to (soft) targets."""

    def __init__(self, size: int, classes: int) -> None:
        self.weights, self.bias = np.zeros((size, classes), np.float32), np.zeros(classes, np.float32)

    def logits(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return row_means(self.weights, ids, rows) + self.bias

    def fit(self, ids: np.ndarray, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 1.0, penalty: float = 1e-6, seed: int = 5, batch: int = 2048) -> None:
        size, classes = self.weights.shape
        rng, square, n = np.random.default_rng(seed), np.full((size, classes), 1e-4, np.float32), np.diff(rows)
        for _ in range(epochs):
            order = rng.permutation(np.flatnonzero(n > 0))
            for i in range(0, len(order), batch):
                own = np.sort(order[i : i + batch])
                at = np.concatenate([[0], np.cumsum(n[own])])
                index = np.arange(at[-1]) + np.repeat(rows[own] - at[:-1], n[own])
                used, place = np.unique(ids[index], return_inverse=True)
                w = self.weights[used]
                p = softmax(np.add.reduceat(w[place], at[:-1], axis=0) / n[own][:, None] + self.bias)
                error = (p - target[own]) * weight[own][:, None]
                share = np.repeat(error / n[own][:, None], n[own], axis=0)
                gradient = np.stack([np.bincount(place, share[:, c], len(used)) for c in range(classes)], axis=1).astype(np.float32) + penalty * w
                square[used] += gradient**2
                self.weights[used] = w - rate * gradient / np.sqrt(square[used])
                self.bias -= 0.05 * error.mean(axis=0)
