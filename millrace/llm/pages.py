"""Problem 2: the main body of web pages, by boosted trees over nodes of the page.

A page is a tree: page, blocks, lines.  A block is a run of lines of one kind
(sentence, short line, code, row of links).  Lines are described by their
text, by their block and its density, by depth and place, by their siblings,
and by what all pages show: on how many hosts and pages a line stands (numbers
and the site's own name masked), on how many pages of its own host, and how
often titles have its pattern of words, as links to other pages have.

No page is labelled.  Rules label the lines of a bounded sample that are
plain to see (a line that most pages of a site repeat; a sentence that stands
nowhere else), and the trees learn from these.  Decoding is hierarchical: a
block is main body or not, and a line departs from its block only if its own
score outweighs the cost.

Fetches of one page under several ids count once in all statistics.  Null and
empty texts have no lines; blank lines are never given.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .sampling import bounded

SAMPLE = 1500  # most pages whose lines the trees are fitted to
TOGETHER = 500  # pages whose lines are scored at once
DEPART = 1.0  # cost of a line that departs from its block, in log-odds

_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d[\d.,]*")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_INNER = re.compile(r"(?<=[a-z,] )[A-ZÀ-Ý][a-zà-ÿ'’-]+\b(?= [a-z])")
_CODE = re.compile(r"^\s*(?:def |class |return\b|import |from \w+ import|if .*:$|for .*:$|while .*:$|else:|elif .*:$|try:|except\b.*:$|#\s|//|/\*|\$ |>>> |\{|\}|var |let |const |function |public |select )|[;{]\s*$|^\s*[\w.\[\]]+ (?:=|\+=|-=) \S|^\s*[\w.]+\(.*\)\s*;?$")
_LINKS = re.compile(r"\s[|/»>›·•]\s|  +|\s[»>]")
_READ = re.compile(r"\b\d+ min(?:ute)?s? read\b")
#: Words that a pattern of words keeps.
KEPT = frozenset("the a an of in on and is was are to for with how why when what where who notes release at by from your you we our not or as".split())


def host(uri: str | None) -> str:
    m = re.match(r"^\s*(?:[a-z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", uri or "", re.I)
    return m.group(1).lower() if m else ""


def page_key(uri: str | None) -> str:
    """The page of an address: without fragment, query, index file, ending and trailing slashes."""
    return re.sub(r"(?:/index)?(?:\.x?html?|\.php)?/*$", "", re.sub(r"[?#].*$", "", (uri or "").strip().lower()))


def site(name: str) -> str:
    """The part of a host name that a site calls itself by."""
    parts = [p for p in name.split(".") if p not in ("www", "com", "org", "net", "example", "co")]
    return max(parts[-1:] or [""], key=len)


@functools.lru_cache(1)
def _named(name: str) -> re.Pattern:
    return re.compile(re.escape(name), re.I)


def template(line: str, name: str) -> str:
    """A line without numbers, the site's own name and other names within it."""
    out = line.strip()
    if len(name) > 3:
        out = _named(name).sub("~", out)
    if not out.isupper():
        out = _INNER.sub("~", out)
    return _NUMBER.sub("0", out.lower())


def skeleton(line: str) -> str:
    """The pattern of a line's words: function words, X for names, w for other words, 0 for numbers."""
    out = []
    for i, w in enumerate(re.findall(r"[^\s]+", _READ.sub("", line).strip(" —–-"))):
        bare = w.strip(".,:;()\"'")
        if bare.lower() in KEPT:
            out.append(bare.lower())
        elif bare[:1].isdigit():
            out.append("0")
        else:
            out.append(("X" if bare[:1].isupper() and i else "w") + (w[-1] if w[-1:] in ":,;" else ""))
    return " ".join(out)


KNOWN = 1 << 15  # lines of which the facts are kept: sites repeat theirs on every page
SHORT = 300  # longer lines are looked at anew each time


def kept_for_short(of):
    """Keep what a function gave for short lines that come again, for a bounded number of them."""
    again = functools.lru_cache(KNOWN)(of)

    @functools.wraps(of)
    def one(line: str, *more: str):
        return again(line, *more) if len(line) <= SHORT else of(line, *more)

    return one


@kept_for_short
def line_facts(x: str) -> tuple[float, ...]:
    """What a line's own text shows: words, characters, ends, links, digits, capitals, reading time, function words, shouting, question, code."""
    words = _WORD.findall(x)
    n, chars = max(len(words), 1), len(x)
    return (
        len(words), chars, x[-1] in ".!?", x.endswith(("…", "...")), x[-1] in ":;,", len(_LINKS.findall(x)), len(_DIGIT.findall(x)) / chars, sum(w[0].isupper() for w in words) / n,
        bool(_READ.search(x)), sum(w.lower() in KEPT for w in words) / n, x.isupper(), x.endswith("?"), bool(_CODE.search(x)),
    )


@kept_for_short
def slugged(x: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", x).strip("-")


def _hash(kind: str, text: str) -> int:
    raw = text.encode()
    return (zlib.crc32(kind.encode() + raw) << 31) ^ zlib.crc32(raw + b"#" + kind.encode())


@kept_for_short
def hashed_template(line: str, name: str) -> int:
    return _hash("t", template(line, name))


@kept_for_short
def hashed_skeleton(line: str) -> int:
    return _hash("s", skeleton(line))


def looked_up(pages: DataFrame) -> DataFrame:
    """(fetch_id, line, host, page, same, pattern): hashes of every line that isn't blank; line 0 is the title's pattern."""
    kind = dict(pages.dtypes)["fetch_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fetch, uri, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                h = host(uri)
                name, own, page = site(h), _hash("h", h), _hash("p", page_key(uri))
                if title and title.strip():
                    out.append((fetch, 0, own, page, 0, _hash("s", skeleton(title))))
                for i, line in enumerate(text.split("\n"), 1):
                    if line.strip():
                        out.append((fetch, i, own, page, hashed_template(line, name), hashed_skeleton(line)))
            types = (batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 6, types)], ["fetch_id", "line", "host", "page", "same", "pattern"])

    return pages.select("fetch_id", "uri", "text", "title").mapInArrow(run, f"fetch_id {kind}, line int, host long, page long, same long, pattern long")


STATS = "stats array<struct<line:int,hosts:long,pages:long,own:long,titles:long,pattern:long>>"


def described(pages: DataFrame) -> DataFrame:
    """Pages with, for every line that isn't blank, on how many hosts, pages and pages of its host it stands, and how many titles have its pattern."""
    from .storage import store

    rows = store(looked_up(pages))
    lines = rows.filter("line > 0")
    inside = lines.select("same", "host", "page").distinct().groupBy("same", "host").agg(F.count("*").alias("own"))
    across = inside.groupBy("same").agg(F.count("*").alias("hosts"), F.sum("own").alias("pages")).filter("pages > 1")
    titles = rows.filter("line = 0").select("pattern", "page").distinct().groupBy("pattern").agg(F.count("*").alias("titles"))
    joined = lines.join(inside.filter("own > 1"), ["same", "host"], "left").join(across, "same", "left").join(titles, "pattern", "left")
    one = lambda c: F.coalesce(c, F.lit(1)).cast("long").alias(c)
    stats = joined.groupBy("fetch_id").agg(F.collect_list(F.struct("line", one("hosts"), one("pages"), one("own"), F.coalesce("titles", F.lit(0)).cast("long").alias("titles"), "pattern")).alias("stats"))
    return pages.select("fetch_id", "uri", "text", "title", "content_type").join(stats, "fetch_id")


NAMES = (
    "hosts", "pages", "pages per host", "own", "titles", "is title", "in address", "words", "characters", "full stop", "other end", "teaser", "code", "separators", "digits", "capitals", "min read", "own name", "place", "from end",
    "after title", "before title", "kept words", "seen before", "seen later", "kind", "block lines", "place in block", "block words", "block hosts", "block titles", "block own", "density 3", "density 9", "hosts near", "titles near", "prose before", "prose after", "site before", "site after", "page lines", "page prose", "markup", "shouted", "question", "like a sibling",
)


class Page:
    """Features of the lines of one page that aren't blank, and (with ``labels``) the labels that rules give them."""

    def __init__(self, uri: str | None, text: str, title: str | None, content_type: str | None, stats: list, labels: bool = True) -> None:
        known = {s["line"]: s for s in stats}
        lines = [(i, x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
        self.numbers = np.array([i for i, _ in lines], np.int32)
        n = len(lines)
        h = host(uri)
        name = site(h)
        address = re.sub(r"[^a-z0-9]+", "-", page_key(uri))
        own_title = (title or "").strip().lower()
        values = np.array([[known[i][k] if i in known else d for k, d in (("hosts", 1), ("pages", 1), ("own", 1), ("titles", 0))] for i, _ in lines], float).reshape(n, 4)
        hosts, pages, own, titles = values.T
        facts = np.array([line_facts(x) for _, x in lines]).reshape(n, 13)
        size, chars, stop, teaser, other, links, digits, capitals, read, kept, shouted, asks, code = facts.T
        low = [x.lower() for _, x in lines]
        slug = [slugged(x) for x in low]
        is_title = np.array([bool(own_title) and x == own_title for x in low], float)
        in_address = np.array([len(s) > 8 and s in address for s in slug], float)
        named = np.array([len(name) > 3 and name in x for x in low], float)
        shape = [known[i]["pattern"] if i in known else None for i, _ in lines]
        alike = np.array([float(k > 0 and shape[k] == shape[k - 1] or k + 1 < n and shape[k] == shape[k + 1]) for k in range(n)])
        prose = ((size >= 7) & (stop > 0) & (teaser == 0) & (code == 0)).astype(float)
        kind = np.where(code > 0, 2, np.where(links > 1, 3, np.where(prose > 0, 1, 0)))
        at = int(np.argmax(is_title + in_address)) if n and (is_title + in_address).any() else -1
        head = np.zeros(n)
        if at >= 0:
            head[at] = 1
        first_seen: dict[str, int] = {}
        before, later = np.zeros(n), np.zeros(n)
        for k, (_, x) in enumerate(lines):
            if x in first_seen:
                before[k], later[first_seen[x]] = 1, 1
            first_seen[x] = k
        begins = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if n else np.zeros(0, int)
        self.block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        in_block = np.bincount(self.block, minlength=len(begins)).astype(float)
        mean = lambda v: (np.bincount(self.block, v, len(begins)) / in_block)[self.block]

        def near(v: np.ndarray, reach: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(v)])
            low, high = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
            return (total[high] - total[low] - v) / np.maximum(high - low - 1, 1)

        repeated = (pages / np.maximum(hosts, 1) >= 1.8) & (pages >= 4) | (own >= 3)
        distance = lambda mask: np.minimum(np.arange(n) - np.maximum.accumulate(np.where(mask, np.arange(n), -30)), 30)
        back = lambda mask: distance(mask[::-1])[::-1]
        order = np.arange(n)
        plain = (content_type or "").split(";")[0].strip().lower() in ("text/plain", "text/markdown")
        self.x = np.stack([
            np.log1p(hosts), np.log1p(pages), pages / np.maximum(hosts, 1), np.log1p(own), np.log1p(titles), head * is_title, head * in_address, np.minimum(size, 40), np.minimum(chars, 300), stop, other, teaser, code, links, digits, capitals, read, named, order / max(n, 1), np.minimum(n - order, 40),
            np.clip(order - at, 0, 40) if at >= 0 else np.full(n, 20), np.clip(at - order, 0, 40), kept, before, later, kind, in_block[self.block], order - begins[self.block] if n else order, mean(size), mean(np.log1p(hosts)), mean((titles > 2).astype(float)), mean(np.log1p(own)), near(size, 3), near(size, 9),
            near(np.log1p(hosts), 2), near((titles > 2).astype(float), 2), distance(prose + code > 0), back(prose + code > 0), distance(repeated), back(repeated), np.full(n, n), np.full(n, prose.mean() if n else 0), np.full(n, plain), shouted, asks, alike,
        ], axis=1).astype(np.float32) if n else np.zeros((0, len(NAMES)), np.float32)
        if not labels:
            return
        # Labels by rules: 0 not main body, 1 main body, -1 unknown.
        label = np.full(n, -1)
        link = (titles > 2) & (prose == 0) & (code == 0)
        label[prose > 0] = np.where(repeated | (named > 0) & (hosts > 1), 0, 1)[prose > 0]
        label[(repeated | (teaser > 0) | link | (links > 1)) & (prose == 0) & (code == 0)] = 0
        label[code > 0] = 1
        label[(alike > 0) & (label < 0) & (titles <= 2) & (size >= 3) & (hosts <= 2) & (named == 0)] = 1
        anchor = label.copy()
        for k in np.flatnonzero(label < 0):
            left = next((anchor[j] for j in range(k - 1, max(-1, k - 9), -1) if anchor[j] >= 0), -1)
            right = next((anchor[j] for j in range(k + 1, min(n, k + 9)) if anchor[j] >= 0), -1)
            if left == right == 1 and not repeated[k]:
                label[k] = 1
            elif left == right == 0:
                label[k] = 0
        label[head > 0] = 1
        self.label = label


def decode(score: np.ndarray, block: np.ndarray, cost: float = DEPART) -> np.ndarray:
    """Main body or not for every line: the best labels of blocks and lines, where departing from the block costs."""
    if not len(score):
        return np.zeros(0, bool)
    if_main = np.maximum(score, -cost)  # gain of the line's best label in a block of the main body
    if_not = np.maximum(score - cost, 0)
    main = np.bincount(block, if_main) >= np.bincount(block, if_not)
    return np.where(main[block], score > -cost, score > cost)


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    rows = bounded(pages, ["fetch_id"], sample, "text")
    own = [Page(r["uri"], r["text"], r["title"], r["content_type"], r["stats"]) for r in rows]
    x, y = np.concatenate([p.x for p in own] or [np.zeros((0, len(NAMES)))]), np.concatenate([p.label for p in own] or [np.zeros(0)])
    if not (y >= 0).any():
        return None
    model = Boosted()
    model.fit(x[y >= 0], (y[y >= 0] > 0).astype(float))
    return model


def boilerplate(pages: DataFrame, sample: int = SAMPLE, cost: float = DEPART) -> DataFrame:
    """(fetch_id, line_no) of every line that isn't part of a page's main body; lines count from 1."""
    from .storage import store

    kind = dict(pages.dtypes)["fetch_id"]
    one = pages.filter("fetch_id is not null and text is not null").dropDuplicates(["fetch_id"])
    known = store(described(one))
    model = fitted(known, sample)
    if model is None:
        return known.filter("false").select("fetch_id", F.lit(1).alias("line_no"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                pages_ = [Page(*rest, labels=False) for rest in zip(*(c.to_pylist() for c in part.columns[1:]))]
                lines = np.array([len(p.numbers) for p in pages_])
                blocks = np.concatenate([[0], np.cumsum([p.block[-1] + 1 if len(p.block) else 0 for p in pages_])])
                # All pages' lines are scored and decoded together; blocks of different pages are different.
                block = np.concatenate([p.block + b for p, b in zip(pages_, blocks)])
                wrong = ~decode(shared.value.score(np.concatenate([p.x for p in pages_])), block.astype(np.int64), cost)
                page = np.repeat(np.arange(len(pages_)), lines)[wrong]
                numbers = np.concatenate([p.numbers for p in pages_])[wrong]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page)), pa.array(numbers.astype(np.int32))], ["fetch_id", "line_no"])

    return known.select("fetch_id", "uri", "text", "title", "content_type", "stats").mapInArrow(run, f"fetch_id {kind}, line_no int")
