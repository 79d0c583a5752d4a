"""Vectorised word and shingle hashing over Arrow string arrays.

Words are maximal runs of letters and digits of the lower-cased text.  A word's
64-bit hash depends only on its UTF-8 bytes, so it is the same on every
executor and in every run.  Work goes in blocks of a few MB cut between words,
so one very long text needs no more memory than its words' hashes.

Nulls count as empty texts; an empty text has no words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        up = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
        down = np.concatenate([one, np.cumprod(np.full(n, _INVERSE, np.uint64))])
    return up, down


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_WORD = np.zeros(256, np.uint8)
for _b in range(128, 256):
    _WORD[_b] = _b
for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[ord(_c)] = ord(_c)
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[ord(_c)] = ord(_c.lower())


def plain(texts: pa.Array) -> pa.Array:
    """Large strings in which every byte from 128 on belongs to a letter or digit of a word."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    other = pc.invert(pc.string_is_ascii(texts))
    if pc.any(other).as_py():
        some = pc.replace_substring_regex(pc.utf8_lower(texts.filter(other)), r"[^\p{L}\p{N}]+", " ")
        texts = pc.replace_with_mask(texts, other, some)
    return texts


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, in order; no word crosses a row."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:  # cut where a word ends
            step = 1 << 12
            while True:
                gap = np.flatnonzero((table[data[to : to + step]] == 0) | edge[to : min(n, to + step)])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(n, to + step)
                if to == n:
                    break
        codes = table[data[at:to]]
        word = np.empty(len(codes) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = codes != 0
        cut = edge[at : to + 1]
        first = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        last = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        size = 1 << max(12, (len(codes) + 1).bit_length())
        up, down = _powers(size)
        with np.errstate(over="ignore"):
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * up[: len(codes)], out=total[1:])
            hashes = mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        out.append((first + at, last + at, hashes))
        at = to
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, and each row's offset in them."""
    data, offsets = raw(plain(texts))
    first, _, hashes = spans(data, offsets)
    return hashes, np.searchsorted(first, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with row offsets; a row of fewer words has one run of all of them."""
    n = np.diff(rows)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            total = mix64(total * np.uint64(3) + hashes[k : k + len(total)])
        keep = np.zeros(len(total), bool)
        counts = np.maximum(n - size + 1, 0)
        if len(total):
            step = np.zeros(len(total) + 1, np.int64)
            np.add.at(step, rows[:-1][counts > 0], 1)
            np.add.at(step, (rows[:-1] + counts)[counts > 0], -1)
            keep = np.cumsum(step[:-1]) > 0
        short = np.flatnonzero((n > 0) & (n < size))
        if not len(short):
            return total[keep], np.concatenate([[0], np.cumsum(counts)])
        tail = np.zeros(len(short), np.uint64)
        for k in range(size):
            has = n[short] > k
            tail[has] = mix64(tail[has] * np.uint64(5) + hashes[rows[:-1][short[has]] + k])
        counts[short] = 1
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.uint64)
        own = np.ones(at[-1], bool)
        own[at[:-1][short]] = False
        out[own] = total[keep]
        out[at[:-1][short]] = tail
        return out, at


def rowid(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One 64-bit value per row for its whole sequence of words; 0 if it has none."""
    n = np.diff(rows)
    with np.errstate(over="ignore"):
        index = np.arange(len(hashes), dtype=np.uint64) - np.repeat(rows[:-1], n).astype(np.uint64)
        each = mix64(hashes + index * np.uint64(0xD6E8FEB86659FD93))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(each, out=total[1:])
        out = mix64(total[rows[1:]] - total[rows[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out.view(np.int64)


def minima(values: np.ndarray, rows: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """MinHash signature of every row (rows x count, uint32); rows without values hold the largest value."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full((len(rows) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(rows) > 0)
    if not len(some):
        return out
    begin = rows[:-1][some]
    step = max(1, (1 << 16) // max(1, int(len(values) / len(some))))
    for i in range(0, len(some), step):  # blocks that stay in the processor's cache
        lo, hi = begin[i], rows[some[min(i + step, len(some)) - 1] + 1]
        x, at, own = low[lo:hi], begin[i : i + step] - lo, some[i : i + step]
        for k in range(count):
            with np.errstate(over="ignore"):
                y = (x ^ b[k]) * a[k]
                y ^= y >> np.uint32(15)
            out[own, k] = np.minimum.reduceat(y, at)
    return out
