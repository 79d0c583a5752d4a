"""Problem 1: evaluation records that occur again in training, by a segment join.

A text of n segments (its distinct runs of ``size`` words) that is linked with
another shares at least the part ``threshold`` of them, so edits spoil at most
k = n - ceil(threshold * n).  Of the k + 1 segments that come first in one
order for all texts, at least one is left unspoilt, however the edits are
spread: evaluation's are looked up among training's.  The order is from rare
to frequent, as a sketch of fixed size counts segments in training, so that
what is looked up is rare.

Segments may match only at allowed places: two linked texts of x and y segments
share at least threshold / (1 + threshold) * (x + y), all of them at or behind
their first common one in both orders.  Pairs of which the places and number of
the common segments, or bit sets of both texts, rule that out are dropped.  No
linked pair is.

The others are verified: banded dynamic programming over the words finds texts
that are at most ``EDITS`` insertions, deletions or substitutions apart (each
spoils ``size`` segments at most, which links long texts); the exact
similarity decides on what it leaves open, as texts may be linked whose parts
were put in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classes as C
from . import words as W
from .bits import bitmap, set_in
from .storage import store

COUNTERS = 22  # bits of a shingle's place in the sketch
EDITS = 4  # of the band
SLACK = 1e-6  # for rounding; only ever admits more


def _shingles(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    w, rows = C.unpack(batch.column(1))
    return W.shingles(w.astype(np.uint64), rows, size)


def asked(evaluation: DataFrame, size: int) -> DataFrame:
    """(key): the shingles of the evaluation classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingles(batch, size)[0]).view(np.int64))], ["key"])

    return evaluation.select("rid", "words").mapInArrow(run, "key long")


def sketch(training: DataFrame, size: int, bitmap: np.ndarray) -> np.ndarray:
    """How frequent the shingles of the bitmap are in training: a level of 0 to 254 for each of 2 ** COUNTERS places, 0 only where there are none."""
    shared = training.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            key, _ = _shingles(batch, size)
            place, n = np.unique((key[set_in(bits, key)] & np.uint64((1 << COUNTERS) - 1)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], ["place", "n"])

    counts = training.select("rid", "words").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(254), F.floor(F.log2(F.col("n") + 1) * 8)).cast("long")
    rows = counts.withColumn("level", level).groupBy(F.shiftright("place", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(level, (place & 7) * 8)")).alias("set")).toPandas()
    out = np.zeros(1 << (COUNTERS - 3), np.int64)
    out[rows["at"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint8)


def posted(classes: DataFrame, size: int, threshold: float, bitmap: np.ndarray, levels: np.ndarray) -> DataFrame:
    """(rid, key, place, total): the first of a class's shingles, if both sides can have them, with their places in the order and the number of all."""
    shared = classes.sparkSession.sparkContext.broadcast((bitmap.tobytes(), levels.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, level = np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.uint8)
        for batch in batches:
            s, at = _shingles(batch, size)
            rank = np.where(set_in(bits, s), level[(s & np.uint64((1 << COUNTERS) - 1)).astype(np.int64)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            s = (rank << np.uint64(56)) | (s >> np.uint64(8))  # sorts by the order
            own = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
            n = np.array([len(x) for x in own], np.int64)
            first = np.where(n > 0, n - np.ceil(threshold * n - SLACK).astype(np.int64) + 1, 0)
            rid, total = np.repeat(batch.column(0).to_numpy(), first), np.repeat(n, first)
            key = np.concatenate([s[:0], *(x[:k] for x, k in zip(own, first))])
            place = np.arange(len(key)) - np.repeat(np.cumsum(first) - first, first)
            both = key >= np.uint64(2 << 56)
            yield pa.RecordBatch.from_arrays([pa.array(rid[both]), pa.array(key[both].view(np.int64)), pa.array(place[both].astype(np.int32)), pa.array(total[both].astype(np.int32))], ["rid", "key", "place", "total"])

    return classes.select("rid", "words").mapInArrow(run, "rid long, key long, place int, total int")


def candidates(evaluation: DataFrame, training: DataFrame, threshold: float, size: int = 3, block: int = 20_000) -> DataFrame:
    """Pairs (a, b) of an evaluation and a training class, with all whose similarity is at least ``threshold``.

    A key's own first byte tells how frequent it is in training, so a frequent
    one is parted in blocks without a count: training's posts of it lie in
    blocks by class, and evaluation's meet all blocks.
    """
    bits = bitmap(asked(evaluation, size))
    levels = sketch(training, size, bits)
    mine, theirs = (posted(side, size, threshold, bits, levels) for side in (evaluation, training))
    blocks = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(2.0), (F.shiftrightunsigned("key", 56) - 1) / 8) / block)).cast("int")
    # Three numbers a post: the class, the key with its block, and place and total in one.
    both = F.shiftleft(F.col("place").cast("long"), 32) + F.col("total")
    left = mine.select(F.col("rid").alias("a"), "key", both.alias("p"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).select("a", F.xxhash64("key", "block").alias("k"), "p")
    right = theirs.select(F.col("rid").alias("b"), F.xxhash64("key", F.pmod(F.xxhash64("rid"), blocks).cast("int")).alias("k"), both.alias("q"))
    low = lambda c: F.col(c).bitwiseAND((1 << 32) - 1).cast("int")
    hits = left.join(right, "k").select("a", "b", F.shiftright("p", 32).cast("int").alias("i"), low("p").alias("x"), F.shiftright("q", 32).cast("int").alias("j"), low("q").alias("y"))
    need = F.ceil((F.col("x") + F.col("y")) * (threshold / (1 + threshold)) - SLACK)
    # The first common shingle has all others behind it in both texts.
    hits = hits.filter((F.col("a") != F.col("b")) & (F.col("i") + need <= F.col("x")) & (F.col("j") + need <= F.col("y")))
    after = F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j")) - 1
    # A class may come from several batches: its hits then count more than once, which only ever admits more.
    shared = hits.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(after).alias("after"), F.max(need).alias("need"))
    return store(shared.filter(F.col("n") + F.col("after") >= F.col("need")).select("a", "b"))


def overlaps(evaluation: DataFrame, training: DataFrame, classes: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(a, b, similarity): all linked pairs of different evaluation and training classes; similarity is a lower bound where the band settled it."""
    return C.similar(candidates(evaluation, training, threshold, size), classes, threshold, size, EDITS)
