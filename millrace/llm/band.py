"""Edit distance of many pairs of sequences within a band."""

from __future__ import annotations

import numpy as np


def within(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, k: int, block: int = 8192) -> np.ndarray:
    """Which pairs of sequences are at most k insertions, deletions or substitutions apart.

    Banded dynamic programming, for a block of pairs of similar length at once:
    row i holds the distances of the first i letters of x to the first i + d of
    y, for -k <= d <= k.
    """
    n, m = np.diff(xs), np.diff(ys)
    out = np.zeros(len(n), bool)
    near = np.flatnonzero(np.abs(n - m) <= k)
    near = near[np.argsort(n[near], kind="stable")]
    far, band = k + 1, np.arange(-k, k + 1)
    for i in range(0, len(near), block):
        own = near[i : i + block]
        a, b = n[own], m[own]
        long = int(a.max())
        p = np.zeros((len(own), long), np.uint32)
        q = np.zeros((len(own), long + 2 * k + 1), np.uint32)
        for target, source, start, size, shift in ((p, x, xs, a, 0), (q, y, ys, b, k)):
            row = np.repeat(np.arange(len(own)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            target[row, place + shift] = source[np.repeat(start[own], size) + place]
        last = np.broadcast_to(np.where(band >= 0, band, far), (len(own), 2 * k + 1)).copy()
        result = np.where(a == 0, b, far)
        for r in range(1, long + 1):
            column = r + band[None, :]
            real = (column >= 0) & (column <= b[:, None])
            same = p[:, r - 1][:, None] == q[:, r - 1 : r + 2 * k]
            new = np.where(column > 0, last + ~same, far)
            new[:, :-1] = np.minimum(new[:, :-1], last[:, 1:] + 1)
            new = np.where(column == 0, np.minimum(r, far), new)
            for d in range(1, 2 * k + 1):
                new[:, d] = np.minimum(new[:, d], new[:, d - 1] + 1)
            last = np.minimum(np.where(real, new, far), far)
            ends = a == r
            result[ends] = last[np.flatnonzero(ends), (b - a)[ends] + k]
        out[own] = result <= k
    return out
