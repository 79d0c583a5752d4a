"""Problem 9: sources mixed to target weights, by exact token lengths.

Documents are counted by source and exact length, once, over the whole table;
only that histogram comes to the driver (as many rows as there are different
lengths, not documents).  Each source gets its budget of tokens: whole
repetitions of the source first, and of what remains a subset of documents, an
equal share of every length moved by dynamic programming to the nearest sum
that there is.  Which documents of a length are drawn is decided by a seeded
hash.

The total defaults to the largest at which every source with documents can
reach its share within its cap.  Targets without documents get nothing, and
the others' shares are scaled up accordingly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def source_name(source: Column | str) -> Column:
    """Spelling of a source in the targets: lower case, with underscores, without outer blanks."""
    x = F.col(source) if isinstance(source, str) else source
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), r"[\s-]+", "_")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many items of each length to take so that their sum is the largest that is at most the budget."""
    items: list[tuple[int, int]] = []
    for length, n in sorted(zip(lengths, counts), reverse=True):
        n, part = min(n, budget // length if length else 0), 1
        while n > 0:
            take = min(part, n)
            items.append((length, take))
            n, part = n - take, part * 2
    mask, reach, history = (1 << (budget + 1)) - 1, 1, [1]
    for length, take in items:
        reach |= (reach << (length * take)) & mask
        history.append(reach)
        if reach >> budget & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for k in range(len(history) - 1, 0, -1):
        length, take = items[k - 1]
        if not history[k - 1] >> left & 1:
            out[length] = out.get(length, 0) + take
            left -= length * take
    return out


@dataclass
class Draw:
    """One source's part of a mixture: every document ``repeats`` times, and ``more`` documents of each length once more."""

    budget: int
    repeats: int
    more: dict[int, int] = field(default_factory=dict)
    tokens: int = 0


REMEMBERED = 1 << 30  # bits of sums that are kept; those of further steps are worked out again


def _steps(lengths: list[int], up: list[int], down: list[int]) -> list[tuple[int, int, int]]:
    """(place, documents, sum) of steps whose choices give every number from -down to up of each length."""
    out = []
    for i, (length, *ends) in enumerate(zip(lengths, up, down)):
        for sign, n in zip((1, -1), ends):
            part = 1
            while n > 0:
                take = min(part, n)
                out.append((i, sign * take, sign * take * length))
                n, part = n - take, part * 2
    return out


def _moved(steps: list[tuple[int, int, int]], width: int, aim: int, distance: Callable[[int], tuple], remembered: int) -> tuple[int, dict[int, int]]:
    """The sum of chosen steps nearest to the aim, and the documents of each place that give it; sums on the way keep within the width."""
    mask, apart = (1 << (2 * width + 1)) - 1, max(1, -(-len(steps) * 2 * width // remembered))
    reach, kept, done = 1 << width, {0: 1 << width}, 0

    def after(reach: int, by: int) -> int:
        return reach | (reach << by & mask if by > 0 else reach >> -by)

    while done < len(steps) and not reach >> (width + aim) & 1:
        reach, done = after(reach, steps[done][2]), done + 1
        if done % apart == 0:
            kept[done] = reach
    low, high = reach & ((1 << (width + aim + 1)) - 1), reach >> (width + aim)
    sums = ([low.bit_length() - 1 - width] if low else []) + ([(high & -high).bit_length() - 1 + aim] if high else [])
    best = left = min(sums, key=distance)
    out: dict[int, int] = {}
    while left or done:
        # The first step after which the sum was reached is one of those that give it.
        start = max(k for k in kept if k <= done)
        while start and kept[start] >> (width + left) & 1:
            kept.pop(start)
            start = max(k for k in kept if k < start)
        reach, at = kept[start], start
        while not reach >> (width + left) & 1:
            reach, at = after(reach, steps[at][2]), at + 1
        if at == 0:
            break
        place, n, by = steps[at - 1]
        out[place], left, done = out.get(place, 0) + n, left - by, at - 1
    return best, out


def nearest(histogram: dict[int, int], goal: int, remembered: int = REMEMBERED) -> dict[int, int]:
    """How many documents of each length to take so that their sum is as near to the goal (less than all) as any; the smaller of two equally near.

    It starts from an equal share of every length, the largest remainders
    filled up, which misses the goal by less than the longest document, m.
    From there as many as 16 documents are added or taken away, then four times
    as many, and so on, until the goal is met or 3 m are: a nearest draw is
    found by then.  For in the order that adds while the sum isn't above the
    start, and else takes away, sums keep between -m and 2 m; more steps than
    3 m would meet a sum twice, and those between could be left out.  Lengths
    count by their greatest common divisor.
    """
    unit, supply = math.gcd(*histogram), sum(k * n for k, n in histogram.items())
    lengths = sorted(histogram)
    share = {k: histogram[k] * goal // supply for k in lengths}
    gap = goal - sum(k * n for k, n in share.items())
    for k in sorted(lengths, key=lambda k: (-(histogram[k] * goal % supply), k)):
        if k <= gap and share[k] < histogram[k]:
            share[k], gap = share[k] + 1, gap - k
    small = [k // unit for k in lengths]
    distance = lambda x: (abs(x * unit - gap), x)
    aim, m, moves = min((gap // unit, gap // unit + 1), key=distance), max(small), 16
    while True:
        moves = min(moves, 3 * m)
        steps = _steps(small, [min(histogram[k] - share[k], moves) for k in lengths], [min(share[k], moves) for k in lengths])
        best, found = _moved(steps, m * (moves + 2) // 2 + m, aim, distance, remembered)
        if best == aim or moves == 3 * m:
            return {k: share[k] + found.get(i, 0) for i, k in enumerate(lengths) if share[k] + found.get(i, 0)}
        moves *= 4


def draw(histogram: dict[int, int], budget: int, cap: int, whole: int = REMEMBERED) -> Draw:
    """The draw of one source nearest to the budget, within its cap; found in one way at any size (``whole`` bounds what is remembered on the way, not what is found)."""
    supply = sum(k * n for k, n in histogram.items())
    if not supply or budget <= 0:
        return Draw(budget, 0)
    repeats = min(budget // supply, cap)
    out = Draw(budget, int(repeats), {}, int(repeats * supply))
    rest = int(budget - out.tokens) if repeats < cap else 0
    if rest > 0:
        out.more = nearest(histogram, rest, whole)
        out.tokens += sum(k * n for k, n in out.more.items())
    return out


def budgets(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens that each source should give."""
    live = {s: t for s, t in targets.items() if supply.get(s, 0) > 0 and t[0] > 0}
    weight = sum(t[0] for t in live.values())
    if total is None and live:
        total = int(min(supply[s] * cap / (share / weight) for s, (share, cap) in live.items()))
    return {s: int((total or 0) * targets[s][0] / weight) if s in live else 0 for s in targets}


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> DataFrame:
    """(source, doc_id, tokens, repeats) of every document drawn, from (doc_id, source, tokens).

    Null and unknown sources, null ids and documents without tokens are not drawn.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect() if r["source"] and r["target_share"] and r["max_repeats"]}
    known = documents.filter("tokens > 0 and doc_id is not null").select("doc_id", source_name("source").alias("source"), "tokens").filter(F.col("source").isin(list(wanted)))
    histogram: dict[str, dict[int, int]] = {}
    for r in known.groupBy("source", "tokens").agg(F.count("*").alias("n")).toLocalIterator():
        histogram.setdefault(r["source"], {})[r["tokens"]] = r["n"]
    supply = {s: sum(k * n for k, n in h.items()) for s, h in histogram.items()}
    draws = {s: draw(histogram.get(s, {}), b, wanted[s][1]) for s, b in budgets(supply, wanted, total).items()}
    spark = documents.sparkSession
    more = spark.createDataFrame([(s, k, n) for s, d in draws.items() for k, n in d.more.items()], "source string, tokens long, more long")
    base = spark.createDataFrame([(s, d.repeats) for s, d in draws.items()], "source string, base int")
    ranked = numbered(known, ["source", "tokens"], "doc_id", "rank", seed, buckets=32)
    joined = ranked.join(base, "source").join(more, ["source", "tokens"], "left")
    repeats = F.col("base") + F.when(F.col("rank") < F.coalesce("more", F.lit(0)), 1).otherwise(0)
    return joined.select("source", "doc_id", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, most_repeats, actual_share) of every target."""
    sums = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").join(F.broadcast(total))  # one row
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 9).alias("actual_share"),
    )
