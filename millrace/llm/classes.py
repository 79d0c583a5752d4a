"""Texts as word sequences: classes of equal sequences, and the exact similarity of two of them.

Rows whose texts have the same words (letter case and punctuation aside) form
one class, named by a 64-bit hash of the sequence.  Similarity joins compare
classes only, so a group of copies costs as much as one text, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .band import within
from .bits import having
from .storage import store

def message_text(messages: Column | str) -> Column:
    """Contents of the messages in order, joined by a blank; null and empty messages give an empty text."""
    column = F.col(messages) if isinstance(messages, str) else messages
    return F.coalesce(F.array_join(F.transform(column, lambda m: F.coalesce(m["content"], F.lit(""))), " "), F.lit(""))


def _binary(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """One binary value per row out of consecutive uint32."""
    offsets = (rows * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 values of a binary column and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = W.raw(column.cast(pa.large_binary()))
    return data.view(np.uint32) if data.ctypes.data % 4 == 0 else np.frombuffer(data.tobytes(), np.uint32), offsets // 4


def fold(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def hashed(texts: DataFrame) -> DataFrame:
    """(tbl, key, rid, words): the class of every row of (tbl, key, text) whose text has a word, and its words, four bytes each.

    One pass over the texts, stored.  Rows and classes met again in a batch are
    given once (``words`` is null for the others of a class), so what a task
    keeps is bounded; null keys and texts without words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = W.words(batch.column(2))
            rid = W.rowid(hashes, rows)
            some, seen, classes = np.diff(rows) > 0, set(), set()
            first = np.zeros(batch.num_rows, bool)
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rid.tolist())):
                if some[i] and row not in seen:
                    seen.add(row)
                    first[i] = row[2] not in classes
                    classes.add(row[2])
                else:
                    some[i] = False
            words = pc.if_else(pa.array(first), _binary(fold(hashes), rows), pa.scalar(None, pa.binary()))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rid), words], ["tbl", "key", "rid", "words"])
            yield out.filter(pa.array(some))

    return store(texts.filter("key is not null and text is not null").select("tbl", "key", "text").mapInArrow(run, "tbl string, key string, rid long, words binary"))


def members(rows: DataFrame) -> DataFrame:
    """(tbl, key, rid) of hashed rows, each once."""
    return rows.select("tbl", "key", "rid").distinct()


def class_words(rows: DataFrame) -> DataFrame:
    """(rid, words) of the classes of hashed rows; a class once for every batch that had it."""
    return rows.filter("words is not null").select("rid", "words")


SKETCH = 8  # numbers of 64 bits


def sketches(classes: DataFrame, size: int) -> DataFrame:
    """(rid, total, k0, ...): the number of a class's shingles, and a set of 64 * SKETCH bits, one for each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, at = unpack(batch.column(1))
            s, rows = W.shingles(w.astype(np.uint64), at, size)
            own = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(rows))
            each = np.sort((own << np.uint64(40)) | (s >> np.uint64(24)))
            fresh = np.ones(len(s), bool)
            fresh[1:] = each[1:] != each[:-1]
            total = np.bincount((each[fresh] >> np.uint64(40)).astype(np.int64), minlength=batch.num_rows)
            bits = np.zeros((batch.num_rows, 64 * SKETCH), bool)
            bits[own.astype(np.int64), (W.mix64(s) & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = True
            numbers = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.astype(np.int32)), *(pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(SKETCH))], ["rid", "total", *(f"k{k}" for k in range(SKETCH))])

    return classes.select("rid", "words").mapInArrow(run, "rid long, total int, " + ", ".join(f"k{k} long" for k in range(SKETCH)))


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float, size: int = 3) -> DataFrame:
    """The pairs (a, b) whose similarity can reach the threshold as far as sketches tell; none that does is dropped.

    Every bit in which two sketches differ stands for a shingle that only one
    text has, so texts of x and y shingles share at most (x + y - bits) / 2;
    they must share threshold / (1 + threshold) * (x + y).  One shingle is allowed for, as the
    number of shingles is counted by 40 bits of their hashes.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
    some = store(sketches(having(classes.select("rid", "words"), "rid", wanted.select(F.col("rid").alias("key"))), size).dropDuplicates(["rid"]))
    side = lambda end, mark: some.select(F.col("rid").alias(end), F.col("total").alias(f"{mark}n"), *[F.col(f"k{k}").alias(f"{mark}{k}") for k in range(SKETCH)])
    both = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
    apart = F.lit(0)
    for k in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}")))
    total = F.col("xn") + F.col("yn")
    return both.filter((total - apart) / 2 >= total * (threshold / (1 + threshold)) - 1).select("a", "b")


def set3(words: np.ndarray, size: int = 3) -> np.ndarray:
    """Sorted distinct shingles of one word sequence; of all its words, if they are fewer than ``size``."""
    w = words.astype(np.uint64)
    n = max(1, len(w) - size + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(w))):
            total = W.mix64(total * np.uint64(3) + w[k : k + n] + np.uint64(1))
    return np.unique(total)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    all_ = np.concatenate((a, b))
    all_.sort()
    both = int((all_[1:] == all_[:-1]).sum())
    return both / (len(a) + len(b) - both)


def _picked(values: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of some rows."""
    parts = [values[rows[i] : rows[i + 1]] for i in some]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def similar(pairs: DataFrame, classes: DataFrame, threshold: float, size: int = 3, edits: int = 0) -> DataFrame:
    """The pairs (a, b, similarity) of classes whose shingle sets have a Jaccard similarity of at least ``threshold``.

    ``edits``: texts at most so many words apart, as banded dynamic programming
    finds, and so long that this links them, have the similarity that follows
    from it as the lower bound; all others have their own.
    """
    pairs = store(plausible(pairs, classes, threshold, size))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
    some = store(having(classes.select("rid", "words"), "rid", wanted.select(F.col("rid").alias("key"))).dropDuplicates(["rid"]))
    left = some.select(F.col("rid").alias("a"), F.col("words").alias("wa"))
    right = some.select(F.col("rid").alias("b"), F.col("words").alias("wb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = unpack(batch.column(2)), unpack(batch.column(3))
            value = np.zeros(batch.num_rows)
            sets: dict[int, np.ndarray] = {}
            for i, (p, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if p not in sets:
                    sets[p] = set3(x[xs[i] : xs[i + 1]], size)
                if q not in sets:
                    sets[q] = set3(y[ys[i] : ys[i + 1]], size)
                least = min(len(sets[p]), len(sets[q])) - size * edits, min(len(sets[p]), len(sets[q])) + size * edits
                if edits and least[0] >= threshold * least[1]:
                    value[i] = -least[0] / least[1]
                else:
                    value[i] = jaccard(sets[p], sets[q])
            if len(long := np.flatnonzero(value < 0)):
                near = np.zeros(len(value), bool)
                near[long] = within(*_picked(x, xs, long), *_picked(y, ys, long), edits)
                for i in long:
                    value[i] = -value[i] if near[i] else jaccard(sets[batch.column(0)[i].as_py()], sets[batch.column(1)[i].as_py()])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["a", "b", "similarity"])
            yield out.filter(pa.array(value >= threshold - 1e-12))

    return both.mapInArrow(run, "a long, b long, similarity double")
