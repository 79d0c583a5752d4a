"""A linear-chain conditional random field in numpy, for many short sequences at once."""

from __future__ import annotations

import numpy as np


def _padded(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(rows)
    longest = int(n.max(initial=0))
    out = np.zeros((len(n), longest, *x.shape[1:]), x.dtype)
    place = np.arange(len(x)) - np.repeat(rows[:-1], n)
    out[np.repeat(np.arange(len(n)), n), place] = x
    return out, np.arange(longest)[None, :] < n[:, None]


def _blocks(n: np.ndarray, cells: int = 1 << 16) -> list[np.ndarray]:
    """Sequences that have elements, in blocks of similar length that hold at most ``cells`` elements when padded; a longer one is a block alone."""
    order = np.argsort(n, kind="stable")[int((n == 0).sum()) :]
    size = n[order]
    out, at = [], 0
    while at < len(order):
        # A block may double in length.
        high = int(np.searchsorted(size, 2 * size[at], "left"))
        most = max(1, cells // int(size[high - 1]))
        out.append(order[at : min(high, at + most)])
        at += len(out[-1])
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chain:
    """Scores of tags are linear in the features; neighbouring tags have a score of their own."""

    def __init__(self, features: int, tags: int) -> None:
        self.emission, self.transition, self.start = np.zeros((features, tags)), np.zeros((tags, tags)), np.zeros(tags)

    def _marginals(self, score: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, tags = score.shape
        forward, backward = np.zeros((n, length, tags)), np.zeros((n, length, tags))
        forward[:, 0] = score[:, 0] + self.start
        for t in range(1, length):
            new = _log_sum(forward[:, t - 1][:, :, None] + self.transition[None], 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t][:, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _log_sum(self.transition[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1][:, None], new, 0)
        total = _log_sum(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        pairs = np.zeros((tags, tags))
        for t in range(1, length):
            p = np.exp(forward[:, t - 1][:, :, None] + self.transition[None] + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            pairs += (p * mask[:, t][:, None, None]).sum(axis=0)
        return single, pairs

    def fit(self, x: np.ndarray, rows: np.ndarray, tags: np.ndarray, epochs: int = 60, rate: float = 0.2, penalty: float = 1e-3) -> None:
        """Maximum conditional likelihood with an L2 penalty, by Adam over sequences of similar length together."""
        n, k = np.diff(rows), len(self.start)
        groups = []
        for own in _blocks(n):
            if len(own):
                index = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in own])
                at = np.concatenate([[0], np.cumsum(n[own])])
                groups.append((*_padded(x[index], at), _padded(np.eye(k)[tags[index]], at)[0]))
        parameters = [self.emission, self.transition, self.start]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for epoch in range(1, epochs + 1):
            gradient = [penalty * len(n) * p for p in parameters]
            for features, mask, gold in groups:
                single, pairs = self._marginals(features @ self.emission, mask)
                error = (single - gold) * mask[:, :, None]
                gradient[0] = gradient[0] + np.einsum("ntf,ntk->fk", features, error, optimize=True)
                gradient[1] = gradient[1] + pairs - np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:], optimize=True)
                gradient[2] = gradient[2] + error[:, 0].sum(axis=0)
            for i, p in enumerate(parameters):
                g = gradient[i] / len(n)
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p -= rate * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8)

    def best(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The most likely tag of every element, by sequences (Viterbi)."""
        n, out = np.diff(rows), np.zeros(len(x), np.int64)
        for part in _blocks(n):
            if len(part):
                index = np.concatenate([np.arange(rows[j], rows[j + 1]) for j in part])
                at = np.concatenate([[0], np.cumsum(n[part])])
                score, mask = _padded(x[index] @ self.emission, at)
                value, back = score[:, 0] + self.start, np.zeros(score.shape, np.int64)
                for t in range(1, score.shape[1]):
                    new = value[:, :, None] + self.transition[None]
                    back[:, t] = new.argmax(axis=1)
                    value = np.where(mask[:, t][:, None], new.max(axis=1) + score[:, t], value)
                tag = value.argmax(axis=1)
                path = np.zeros(mask.shape, np.int64)
                for t in range(score.shape[1] - 1, -1, -1):
                    path[:, t] = tag
                    tag = np.where(mask[:, t], back[np.arange(len(tag)), t, tag] if t else tag, tag)
                out[index] = path[mask]
        return out
