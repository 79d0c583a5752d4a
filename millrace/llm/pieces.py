"""Problem 6: items over a size limit cut into pieces at natural boundaries.

A text is a stretch of bytes (files) or characters (table rows) that is dealt
with in ranges.  A range sees a halo before its begin and finds, in the last
stretch of the range before it and of itself, the best place for a cut: those
are the joints, and what lies between two joints is cut without knowledge of
the rest.  So the ranges of one giant file are worked on by many tasks, and no
task holds more than a range and its halo.  Boundary tables are stitched by
adding up the pieces of the ranges before.

Boundaries by rank: paragraph, line, sentence, word, any place.  A piece ends
at the best boundary of its latter half; the next begins at the best boundary
within the overlap before that end, or with the whole overlap where there is
none.  A joint is such an end too: the piece after it begins within the
overlap before it, so it differs from other ends only in its place, near a
multiple of the range's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS, OVERLAP = 220, 40  # fixed values: the project's chunk size and overlap in tokens
RANGE = 1 << 16

_PARAGRAPH, _LINE, _SENTENCE, _WORD = re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"[.!?…。！？][\"')\]]*\s+"), re.compile(r"\s+")


def longest(tokens: int) -> int:
    """Most characters of a text of so many tokens, a token being a quarter of a character count."""
    return 4 * tokens + 3


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may begin, in order, and their ranks (4 is best)."""
    rank: dict[int, int] = {}
    for value, pattern in ((1, _WORD), (2, _SENTENCE), (3, _LINE), (4, _PARAGRAPH)):
        for m in pattern.finditer(text):
            rank[m.end()] = value
    places = np.array(sorted(rank), np.int64)
    return places, np.array([rank[p] for p in places.tolist()], np.int64)


def _best(places: np.ndarray, ranks: np.ndarray, low: int, high: int) -> int | None:
    """The last of the best boundaries in (low, high]."""
    i, j = np.searchsorted(places, low, "right"), np.searchsorted(places, high, "right")
    if i == j:
        return None
    own = ranks[i:j]
    return int(places[i + len(own) - 1 - int(np.argmax(own[::-1]))])


def joint(text: str, at: int, low: int) -> int:
    """Where the text is parted at or before ``at``, after ``low``: at the best boundary, else at ``at``."""
    best = _best(*boundaries(text[low:at]), 0, at - low)
    return at if best is None else low + best


def cut(text: str, tokens: int = TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text; they cover it, and each begins at most ``overlap`` tokens before the last's end."""
    most, back = longest(tokens), 4 * overlap
    if not text:
        return []
    places, ranks = boundaries(text)
    out, begin = [], 0
    while True:
        if len(text) - begin <= most:
            out.append((begin, len(text)))
            return out
        end = _best(places, ranks, begin + most // 2, begin + most) or _best(places, ranks, begin + back, begin + most) or begin + most
        out.append((begin, end))
        begin = _back(places, ranks, begin, end, back)


def _back(places: np.ndarray, ranks: np.ndarray, begin: int, end: int, back: int) -> int:
    """Where the piece after one from ``begin`` to ``end`` begins: at the earliest of the best boundaries within the overlap, else with the whole overlap."""
    low = max(begin + 1, end - back)
    i, j = np.searchsorted(places, low), np.searchsorted(places, end)
    return int(places[i + int(np.argmax(ranks[i:j]))]) if i < j else min(low, end)


def _opening(text: str, first: int, overlap: int) -> int:
    """Where the first piece after a joint begins: within the overlap before it."""
    low = max(0, first - longest(overlap))
    places, ranks = boundaries(text[low:first])
    return low + _back(places, ranks, -1, first - low, 4 * overlap) if overlap and first else first


def _stretches(length: int, size: int) -> Iterator[tuple[int, int]]:
    for at in range(0, max(length, 1), size):
        yield at, min(length, at + size)


def stretch_pieces(read, index: int, length: int, tokens: int, overlap: int, size: int, halo: int) -> list[tuple[int, int, str]]:
    """Pieces of one range: read(begin, end) gives characters of the item."""
    begin, end = index * size, min(length, (index + 1) * size)
    low = max(0, begin - halo)
    text = read(low, end)
    first = 0 if begin == 0 else joint(text, begin - low, 0)
    last = len(text) if end == length else joint(text, len(text), max(first, len(text) - halo))
    start = _opening(text, first, overlap) if begin else 0
    return [(low + start + a, low + start + b, text[start + a : start + b]) for a, b in cut(text[start:last], tokens, overlap)]


PIECES = "key string, stretch int, begin long, end long, text string"


def split_texts(texts: DataFrame, tokens: int = TOKENS, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(key, piece, begin, end, text): pieces of every (key, text), numbered from 0; empty and null texts have none.

    A text over ``size`` characters becomes several rows of a range and its halo before it is cut.
    """
    halo = longest(tokens)
    assert size >= 2 * halo
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / size).cast("int") - 1, F.lit(0)))
    low = lambda i: F.greatest(i * size - halo, F.lit(0))
    parts = F.transform(numbers, lambda i: F.struct(i.alias("stretch"), low(i).cast("long").alias("low"), F.substring("text", low(i) + 1, (i + 1) * size - low(i)).alias("part")))
    whole = texts.filter("text is not null and text <> ''").select(F.col("key").cast("string").alias("key"), F.length("text").cast("long").alias("length"), parts.alias("parts"))
    ranges = whole.select("key", "length", F.explode("parts").alias("p")).select("key", "p.stretch", "length", "p.low", "p.part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, stretch, length, at, part in zip(*(c.to_pylist() for c in batch.columns)):
                for begin, end, text in stretch_pieces(lambda a, b, p=part, o=at: p[a - o : b - o], stretch, length, tokens, overlap, size, halo):
                    out.append((key, stretch, begin, end, text))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["key", "stretch", "begin", "end", "text"])

    return numbered(ranges.mapInArrow(run, PIECES))


def numbered(pieces: DataFrame) -> DataFrame:
    """Piece numbers within a key: those of the ranges before, by a sum over the ranges' counts, plus the place in the range."""
    # One range has at most a few hundred pieces, and only counts are summed along a key.
    counts = pieces.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    along = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "stretch", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "stretch").orderBy("begin")
    return pieces.withColumn("own", F.row_number().over(inside) - 1).join(before, ["key", "stretch"]).select("key", (F.col("before") + F.col("own")).alias("piece"), "begin", "end", "text")


def split_files(spark: SparkSession, paths: list[str], tokens: int = TOKENS, overlap: int = OVERLAP, size: int = 1 << 22) -> DataFrame:
    """Pieces of text files by byte offsets: each task reads one range of bytes and its halo; key is the path.

    UTF-8 is read as such; ranges begin and end between characters; bytes that aren't UTF-8 become replacement characters.
    """
    from pyarrow import fs

    halo = 4 * longest(tokens)
    rows = []
    for path in paths:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        length = system.get_file_info(at).size
        rows += [(path, i, length) for i, _ in enumerate(_stretches(length, size))] if length else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, index, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                low, end = max(0, index * size - halo), min(length, (index + 1) * size)
                with system.open_input_file(at) as f:
                    data = f.read_at(min(length, end + 3) - low, low)

                def align(place: int, data: bytes = data) -> int:
                    while place < len(data) and data[place] & 0xC0 == 0x80:
                        place += 1
                    return place

                head, middle, tail = align(0) if low else 0, align(index * size - low), align(end - low)
                before, own = data[head:middle].decode("utf-8", "replace"), data[middle:tail].decode("utf-8", "replace")
                text = before + own
                first = 0 if index == 0 else joint(text, len(before), max(0, len(before) - longest(tokens)))
                last = len(text) if end == length else joint(text, len(text), max(first, len(text) - longest(tokens)))
                start = _opening(text, first, overlap) if index else 0
                for a, b in cut(text[start:last], tokens, overlap):
                    begin = low + head + len(text[: start + a].encode())
                    out.append((path, index, begin, begin + len(text[start + a : start + b].encode()), text[start + a : start + b]))
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["key", "stretch", "begin", "end", "text"])

    frame = spark.createDataFrame(rows, "key string, stretch int, length long").repartition(max(1, len(rows)), "key", "stretch")
    return numbered(frame.mapInArrow(run, PIECES))
