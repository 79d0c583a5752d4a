"""Problem 5: records that differ by small edits, by a signature-coordinate inverted join.

Every class of equal texts gets a MinHash signature over its word shingles.
``values`` neighbouring minima form one coordinate, ``coordinates`` of them a
signature.  Classes are posted under each (coordinate, value) pair.  A value
that only one class has can't collide and is dropped after a count; the rest
of a class is posted rarest first and, since ``matches`` collisions are asked,
without its ``matches - 1`` most frequent values (prefix filter: two classes
with that many common values share one within their prefixes).  Collisions are
counted per pair, pairs below the match threshold dropped, and the exact
similarity decides.

With the default 40 coordinates of 3 minima and 2 matches, a pair of
similarity 0.6 is missed with a probability of 0.0007, one of 0.7 with 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import classes as C
from . import words as W
from .storage import store


def posted(classes: DataFrame, coordinates: int = 40, values: int = 3, size: int = 3) -> DataFrame:
    """(rid, token): every class under each coordinate's value, the coordinate being part of the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, rows = C.unpack(batch.column(1))
            s, at = W.shingles(w.astype(np.uint64), rows, size)
            low = W.minima(s, at, coordinates * values).astype(np.uint64).reshape(len(at) - 1, coordinates, values)
            with np.errstate(over="ignore"):
                token = np.arange(coordinates, dtype=np.uint64)[None, :] + np.uint64(1)
                for k in range(values):
                    token = W.mix64(token * np.uint64(0x9E3779B97F4A7C15) + low[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), coordinates)), pa.array(token.reshape(-1).view(np.int64))], ["rid", "token"])

    return classes.select("rid", "words").mapInArrow(run, "rid long, token long")


def candidates(posts: DataFrame, matches: int = 2, block: int = 5000) -> DataFrame:
    """Pairs (a, b), a < b, with at least ``matches`` equal coordinates."""
    placed = posts.repartition("token")  # one exchange for the count and the join
    frequent = placed.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = placed.join(frequent, "token").groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("t")).filter(F.size("t") >= matches)
    prefix = shared.select("rid", F.explode(F.slice("t", F.lit(1), F.size("t") - (matches - 1))).alias("p"), "t").select("rid", F.col("p.token").alias("token"), F.ceil(F.col("p.n") / block).cast("int").alias("blocks"), F.transform("t", lambda x: x["token"]).alias("all"))
    prefix = store(prefix)
    # A frequent token's posts lie in blocks; each of them meets all blocks.
    a = prefix.select(F.col("rid").alias("a"), "token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("all").alias("x"))
    b = prefix.select(F.col("rid").alias("b"), "token", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), F.col("all").alias("y"))
    hits = a.join(b, ["token", "block"]).filter("a < b")
    return store(hits.filter(F.size(F.array_intersect("x", "y")) >= matches).select("a", "b").distinct())


def links(classes: DataFrame, threshold: float = 0.8, size: int = 5, coordinates: int = 40, values: int = 3, matches: int = 2) -> DataFrame:
    """(a, b, similarity) of all pairs of classes at or above the threshold; a < b as numbers."""
    return C.similar(candidates(posted(classes, coordinates, values, size), matches), classes, threshold, size)
