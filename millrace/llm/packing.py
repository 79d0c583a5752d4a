"""Problem 8: items packed into containers of fixed capacity, by patterns and non-negative least squares.

Only the histogram of lengths comes to the driver; it has at most as many
entries as the capacity, whatever the number of items.  Lengths are put into
classes, and patterns of classes that nearly fill a container are enumerated.
Non-negative least squares fit how often each pattern is used, the counts are
rounded down, and the fit is repeated on what is left until that is a bounded
rest, which is packed best-fit.  The plan gives every class ranges of places,
and an item finds its container by its number within its class.

An item longer than the capacity is split into full pieces and a rest; others
are never split.  Items of length 0 or null lengths need no container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

STEPS = 256


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by coordinate descent on the normal equations."""
    g, h = a.T @ a, a.T @ b
    x, diagonal = np.zeros(a.shape[1]), np.maximum(np.diag(g), 1e-12)
    gradient = -h.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -gradient[j] / diagonal[j])
            if step:
                x[j] += step
                gradient += g[:, j] * step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return x


def classes_of(histogram: dict[int, int], steps: int = STEPS) -> np.ndarray:
    """Upper bounds of classes of lengths: exact up to ``steps``, and at most 1 / steps too long beyond."""
    lengths = np.array(sorted(histogram))
    width = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1) / steps)).astype(np.int64)))
    bounds = -(-lengths // width) * width
    # A class is never longer than its longest item.
    return np.array([lengths[bounds == x].max() for x in np.unique(bounds)])


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, number: int, rng: np.random.Generator) -> np.ndarray:
    """Columns of class counts that fill a container: items drawn as they occur, and for the rest the best fitting two."""
    out: dict[bytes, np.ndarray] = {}
    share = counts / counts.sum()
    large = np.flatnonzero(sizes > capacity // 8)
    firsts = np.concatenate([rng.permutation(large)[: number // 2], rng.choice(len(sizes), number, p=share)])
    mean = (sizes * share).sum()
    drawn = rng.choice(len(sizes), (len(firsts), 96), p=share)
    for first, others in zip(firsts.tolist(), drawn.tolist()):
        column = np.zeros(len(sizes), np.int32)
        room = capacity - int(sizes[first])
        column[first] = 1
        for pick in others:
            if room < 2.5 * mean:
                break
            if sizes[pick] <= room and column[pick] < counts[pick]:
                column[pick] += 1
                room -= int(sizes[pick])
        for _ in range(64):
            fit = np.flatnonzero((sizes <= room) & (counts > column))
            if not len(fit):
                break
            own = sizes[fit]
            other = np.searchsorted(own, room - own, "right") - 1
            filled = own + np.where(other >= 0, own[other], 0)
            best = int(np.argmax(filled))
            for pick in {int(fit[best]), int(fit[other[best]]) if other[best] >= 0 else int(fit[best])}:
                if sizes[pick] <= room:
                    column[pick] += 1
                    room -= int(sizes[pick])
        out.setdefault(column.tobytes(), column)
    return np.array(list(out.values())).T


Plan = dict[int, list[tuple[int, int, int]]]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, number: int = 300, rounds: int = 3, seed: int = 7) -> tuple[Plan, int]:
    """For each class its ranges (first place, items per container, first container), and the number of containers."""
    rng, left = np.random.default_rng(seed), counts.astype(np.int64).copy()
    ranges: Plan = {i: [] for i in range(len(sizes))}
    place, container = np.zeros(len(sizes), np.int64), 0
    for _ in range(rounds):
        some = np.flatnonzero(left > 0)
        if not len(some) or left.sum() <= number:
            break
        columns = patterns(sizes[some], left[some], capacity, number, rng)
        scale = sizes[some][:, None] / capacity
        times = np.floor(nnls(columns * scale, left[some] * scale[:, 0]) + 1e-6).astype(np.int64)
        for j in np.argsort(-(sizes[some] @ columns), kind="stable"):
            column = columns[:, j]
            used = np.flatnonzero(column)
            n = int(min(times[j], (left[some][used] // column[used]).min()))
            if n > 0:
                for i in used:
                    c = int(some[i])
                    ranges[c].append((int(place[c]), int(column[i]), container))
                    place[c] += n * column[i]
                    left[c] -= n * column[i]
                container += n
    # The rest: at most about as many items as the patterns hold, and what no pattern fits.
    gaps: dict[int, list[int]] = {}
    open_gaps = np.zeros(capacity + 1, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        while left[i] > 0:
            fit = np.flatnonzero(open_gaps[sizes[i] :])
            if not len(fit):  # none: as many new containers as this class fills at once
                per = max(1, capacity // int(sizes[i]))
                n = int(left[i] // per)
                full = capacity - per * int(sizes[i])
                if n:
                    ranges[int(i)].append((int(place[i]), per, container))
                    place[i] += n * per
                    left[i] -= n * per
                    if full:
                        gaps.setdefault(full, []).extend(range(container, container + n))
                        open_gaps[full] += n
                    container += n
                    continue
                gap, target = capacity, container
                container += 1
            else:
                gap = int(fit[0] + sizes[i])
                target = gaps[gap].pop()
                open_gaps[gap] -= 1
            take = int(min(left[i], gap // sizes[i]))
            ranges[int(i)].append((int(place[i]), take, target))
            place[i] += take
            left[i] -= take
            if rest := gap - take * int(sizes[i]):
                gaps.setdefault(rest, []).append(target)
                open_gaps[rest] += 1
    return ranges, container


def packed(items: DataFrame, name: str, capacity: int, seed: int = 7) -> DataFrame:
    """(pack_name, container, doc_id, piece, tokens) of items (doc_id, tokens); every token lies in one container."""
    full, rest = F.floor(F.col("tokens") / capacity).cast("long"), F.col("tokens") % capacity
    some = items.filter("tokens > 0 and doc_id is not null")
    whole = some.filter(full > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"), F.lit(capacity).cast("long").alias("tokens"))
    parts = some.filter(rest > 0).select("doc_id", F.when(full > 0, full).otherwise(F.lit(0)).cast("long").alias("piece"), rest.cast("long").alias("tokens"))
    histogram = {r["tokens"]: r["n"] for r in parts.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # < capacity rows
    if not histogram:
        return whole.select(F.lit(name).alias("pack_name"), F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), "doc_id", "piece", "tokens")
    sizes = classes_of(histogram)
    counts = np.zeros(len(sizes), np.int64)
    for length, n in histogram.items():
        counts[np.searchsorted(sizes, length)] += n
    ranges, _ = plan(sizes, counts, capacity, seed=seed)
    flat = [(np.array([r[0] for r in ranges[i]], np.int64), np.array([r[1] for r in ranges[i]], np.int64), np.array([r[2] for r in ranges[i]], np.int64)) for i in range(len(sizes))]
    bounds = [int(x) for x in sizes]
    shared = items.sparkSession.sparkContext.broadcast((np.array(bounds), flat))  # bounded by classes x patterns

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.searchsorted(shared.value[0], batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c.astype(np.int32))], ["doc_id", "piece", "tokens", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            target = np.zeros(len(c), np.int64)
            for k in np.unique(c):
                first, per, base = shared.value[1][k]
                own = c == k
                at = np.searchsorted(first, r[own], "right") - 1
                target[own] = base[at] + (r[own] - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(target)], ["doc_id", "piece", "tokens", "number"])

    kind = dict(items.dtypes)["doc_id"]
    classed = parts.mapInArrow(classify, f"doc_id {kind}, piece long, tokens long, class int")
    ranked = numbered(classed.withColumn("_key", F.xxhash64("doc_id", "piece")), ["class"], "_key", "place", seed, buckets=16)
    placed = ranked.select("doc_id", "piece", "tokens", "class", F.col("place").cast("long")).mapInArrow(run, f"doc_id {kind}, piece long, tokens long, number long")
    placed = placed.select("doc_id", "piece", "tokens", F.concat(F.lit("c-"), F.col("number").cast("string")).alias("container"))
    filled = whole.withColumn("container", F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    return placed.unionByName(filled).select(F.lit(name).alias("pack_name"), "container", "doc_id", "piece", "tokens")


def report(packs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, items, tokens, fill): how full the containers of each pack are."""
    boxes = packs.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("i"))
    sums = boxes.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return capacities.select("pack_name", "capacity_tokens").distinct().join(sums, "pack_name").select("pack_name", "capacity_tokens", "containers", "items", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
