"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

BYTES = 256 << 20  # most characters of all texts of a sample


def bounded(rows: DataFrame, keys: list[str], most: int, size: str | None = None, characters: int = BYTES) -> list[Row]:
    """At most ``most`` rows, drawn by a hash of their keys; all rows if there are no more.

    The share to draw follows from a count, so that no task sends more than
    its share of the sample; the draw is the same in every run.  ``size`` names
    a text: the share is lowered so that the sample's texts have no more than
    ``characters`` together, and a text that alone has more than a hundredth of
    that isn't drawn for fitting.
    """
    if size is not None:
        rows = rows.filter(F.coalesce(F.length(size), F.lit(0)) <= characters // 100)
    count = rows.agg(F.count("*").alias("n"), (F.sum(F.length(size)) if size else F.lit(0)).alias("c")).first()
    share = min(1.0, most / max(1, count["n"]), characters / max(1, count["c"] or 0))
    if share < 1:
        place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
        rows = rows.filter(place < int((1 << 30) * share * 0.97))
    return sorted(rows.limit(most).collect(), key=lambda r: str([r[k] for k in keys]))
