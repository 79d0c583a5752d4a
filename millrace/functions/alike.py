"""Pairs of texts that match in blocks to a given ratio, found without comparing all pairs letter by letter."""

from __future__ import annotations

import bisect
import difflib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np

RUN = 4  # letters of a run
MOST, CHARS = 1024, 1 << 20  # texts and (nearly) characters of a block
_ADDED = 255  # rows that a byte can count


def length_class(n: int) -> int:
    """Texts of one class have lengths that differ by less than a factor of two."""
    return max(6, int(n).bit_length() - 1)


def block_size(c: int) -> int:
    """Texts of a class that make one block."""
    return max(1, min(MOST, CHARS >> (c + 1)))


def run_numbers(text: str) -> np.ndarray:
    """A number of 32 bits for each run of letters of a text, in order."""
    return _numbers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _numbers(code: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(code) - RUN + 1), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            out = (out ^ code[k : k + len(out)]) * np.uint32(0x9E3779B1)
    return out


def _shared(total: np.ndarray | int, least: float) -> np.ndarray:
    """Runs that two texts of so many letters share at least, if they match to the ratio.

    Then ``least * total / 2`` letters are in matching blocks, and there are no
    more blocks than the ``(1 - least) * total`` unmatched letters can part, and
    one; a block shares all its runs but ``RUN - 1``.
    """
    return least * total / 2 - (RUN - 1) * ((1 - least) * total + 1) - 1e-6


class Block:
    """Texts of one class of lengths, and which runs each has near which place.

    Unmatched letters also bound how far a matched run can move: a text of n
    letters has it no more than ``after`` letters later, or ``before`` letters
    earlier, than any that may match to the ratio.
    """

    def __init__(self, keys: list, texts: list[str], c: int, least: float):
        order = sorted(range(len(keys)), key=lambda i: (len(texts[i]), keys[i]))
        self.keys, self.texts, self.least = [keys[i] for i in order], [texts[i] for i in order], least
        self.sizes = np.array([len(t) for t in self.texts])
        self.width = 1 << (c - 2)
        self.bits = min(16, max(12, c + 4))
        places = int(self.sizes[-1] * (2 - least) / least) // self.width + 1
        self.has = np.zeros((places << self.bits, len(order)), np.uint8)
        for y, text in enumerate(self.texts):
            n, runs = len(text), run_numbers(text) >> np.uint32(32 - self.bits)
            before, after = math.ceil(2 * (1 - least) / least * n) + 1, math.ceil(2 * (1 - least) / (2 - least) * n) + 1
            for k in range(places):
                self.has[(k << self.bits) + runs[max(0, k * self.width - before) : (k + 1) * self.width + after].astype(np.int64), y] = 1
        self.often = self.has.sum(axis=1, dtype=np.int32)

    def alike(self, key, text: str, runs: np.ndarray) -> Iterator[int]:
        """Places of the block's texts that have a greater key than a text and may match it to the ratio: none that does is left out."""
        m = len(text)
        low, high = np.searchsorted(self.sizes, m * self.least / (2 - self.least) - 1e-6), np.searchsorted(self.sizes, m * (2 - self.least) / self.least + 1e-6, "right")
        if low >= high:
            return
        rows = (np.arange(len(runs)) // self.width << self.bits) + (runs >> np.uint32(32 - self.bits))
        often = self.often[rows]
        rows = rows[np.argsort(often)]  # the rarest first, so that most texts are ruled out early
        needed = _shared(m + self.sizes[low:high], self.least)
        live, count, done, has = None, np.zeros(high - low, np.int32), int((often == 0).sum()), self.has[:, low:high]
        while True:
            left = count + (len(rows) - done) >= needed
            if not left.any():
                return
            if done == len(rows):
                break
            if left.sum() < len(left) // 2:
                live = np.flatnonzero(left) if live is None else live[left]
                count, needed = count[left], needed[left]
            part = rows[done : done + _ADDED]
            count += np.add.reduce(has[part] if live is None else has[part[:, None], live], axis=0, dtype=np.uint8)
            done += len(part)
        yield from (y for y in low + (np.flatnonzero(left) if live is None else live[left]) if self.keys[y] > key)


def _placed(runs: np.ndarray) -> np.ndarray:
    return np.sort((runs.astype(np.uint64) << np.uint64(32)) + np.arange(len(runs), dtype=np.uint64))


def near_runs(runs: np.ndarray, m: int, placed: np.ndarray, n: int, least: float) -> bool:
    """Whether a text of m letters has as many runs near their places in one of n as a match to the ratio leaves at least."""
    loose = math.floor((1 - least) * (m + n) + 1e-9)
    place, run = np.arange(len(runs)), runs.astype(np.uint64) << np.uint64(32)
    first = np.searchsorted(placed, run + np.maximum(0, place - max(0, (loose + m - n) // 2)).astype(np.uint64))
    last = run + (place + max(0, (loose + n - m) // 2)).astype(np.uint64)
    return bool((np.append(placed, np.iinfo(np.uint64).max)[first] <= last).sum() >= _shared(m + n, least))


def ratios(block: Block, keys: list, texts: list[str], runs: list[np.ndarray]) -> Iterator[tuple]:
    """(lesser key, greater key, their texts, ratio) of the block's texts and others of lesser keys that match to the ratio, the greater key's text being the first of the comparison."""
    matcher, placed = difflib.SequenceMatcher(None), {}
    for key, text, own in zip(keys, texts, runs):
        for y in block.alike(key, text, own):
            if y not in placed:
                placed[y] = _placed(run_numbers(block.texts[y]))
            if not near_runs(own, len(text), placed[y], len(block.texts[y]), block.least):
                continue
            matcher.set_seqs(block.texts[y], text)
            ratio = matcher.ratio()
            if ratio >= block.least:
                yield key, block.keys[y], text, block.texts[y], ratio


def packed(what) -> bytes:
    """What is sent to workers."""
    return zlib.compress(pickle.dumps(what), 1)


def unpacked(sent: bytes):
    return pickle.loads(zlib.decompress(sent))


_opened: list = [None, None]  # what this worker opened last: its name and itself


def opened(name: str, sent: list[tuple[bytes, bytes]], least: float, whole: bool):
    """The texts of some blocks for comparison with others: by ``Index`` or, with ``whole``, all of them by length as ``matched`` takes them."""
    if _opened[0] != name:
        _opened[:] = [None, None]
        texts = [unpacked(t) for t, _ in sent]
        if whole:
            rows = sorted((len(t), k, t) for keys, some in texts for k, t in zip(keys, some))
            _opened[:] = [name, ([k for _, k, _ in rows], [t for *_, t in rows], [run_numbers(t) for *_, t in rows])]
        else:
            _opened[:] = [name, Index([k for keys, _ in texts for k in keys], [t for _, some in texts for t in some], *joined([unpacked(s) for _, s in sent], [len(keys) for keys, _ in texts]), least)]
    return _opened[1]


def compared(block: Block, keys: list, texts: list[str], runs: list[np.ndarray]) -> Iterator[tuple]:
    """``ratios`` of a block and those of the texts, by length, that have a length for it."""
    yield from ratios(block, *_near([block.sizes[0], block.sizes[-1]], block.least, keys, texts, runs))


def _near(sizes: list[int], least: float, *others: list) -> list[list]:
    """Of keys, texts by length and more, those that have a length to match one of the sizes."""
    low = bisect.bisect_left(others[1], math.floor(min(sizes) * least / (2 - least)) - 1, key=len)
    high = bisect.bisect_right(others[1], math.ceil(max(sizes) * (2 - least) / least) + 1, key=len)
    return [x[low:high] for x in others]


FEW = 32  # texts for which no block is made


def matched(keys: list, texts: list[str], c: int, least: float, others: tuple[list, list[str], list[np.ndarray]]) -> Iterator[tuple]:
    """(lesser key, greater key, their texts, ratio) of texts of a class and others of lesser keys, by length, that match to the ratio."""
    near = _near([len(t) for t in texts], least, *others)
    if near[0]:
        yield from (_few_ratios(keys, texts, c, least, *near) if len(near[0]) < FEW else ratios(Block(keys, texts, c, least), *near))


def _few_ratios(keys: list, texts: list[str], c: int, least: float, others: list, their: list[str], runs: list[np.ndarray]) -> Iterator[tuple]:
    """``ratios``, by the runs of all texts that each of the others has near their places."""
    code, ends = laid(texts)
    sizes, width, bits, matcher = np.diff(ends) - 1, 1 << (c - 2), 16, difflib.SequenceMatcher(None)
    place = np.arange(len(code)) - np.repeat(ends, np.append(sizes + 1, 1)) - 1
    runs_of = _numbers(np.append(code, np.full(RUN - 1, _SEP, np.uint32)))
    inside = (place >= 0) & (place + RUN <= np.repeat(np.append(sizes, 0), np.append(sizes + 1, 1)))
    row = ((np.maximum(place, 0) // width) << bits) + (runs_of >> np.uint32(32 - bits))
    places = int(sizes.max()) // width + 1
    for key, text, own in zip(others, their, runs):
        n, own = len(text), (own >> np.uint32(32 - bits)).astype(np.int64)
        back, ahead = math.ceil(2 * (1 - least) / least * n) + 1, math.ceil(2 * (1 - least) / (2 - least) * n) + 1
        has = np.zeros(places << bits, bool)
        for k in range(places):
            has[(k << bits) + own[max(0, k * width - back) : (k + 1) * width + ahead]] = True
        count = np.add.reduceat((has[row] & inside).astype(np.int32), ends[:-1])
        fit = (count >= _shared(sizes + n, least)) & (most_unmatched(sizes, n, least) >= 0) & (most_unmatched(n, sizes, least) >= 0)
        for x in np.flatnonzero(fit):
            if keys[x] > key:
                matcher.set_seqs(texts[x], text)
                ratio = matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0
                if ratio >= least:
                    yield key, keys[x], text, texts[x], ratio


# Signs: runs of letters of which texts that match have some

SIGNS = (6, 9, 13, 20)  # letters of a sign
ENOUGH = 1.5  # losses of the signs that are looked up, in letters that can be unmatched; 1 at least
POPULAR = 200  # letters of a text from which difflib leaves popular ones out
HITS = 1 << 21  # looked at together
_SEP, _BINS, _THERE = 0xFFFFFFFF, 20, 22  # stands before and after every text; bits of the numbers by which runs are counted, and looked for
SIGN = np.dtype([("run", np.uint32), ("text", np.int32), ("place", np.int32), ("loss", np.int32), ("before", np.int32), ("size", np.uint8)])


def laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts with a separator before each and at the end, and the places of the separators."""
    ends = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)])
    code, inner = np.full(int(ends[-1]) + 1, _SEP, np.uint32), np.ones(int(ends[-1]) + 1, bool)
    inner[ends] = False
    code[inner] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, ends


def numbered(code: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place in SIGNS, letters, a number of 32 bits for the run of so many letters from each place)."""
    out, last = np.zeros(len(code), np.uint32), 0
    with np.errstate(over="ignore"):
        for s, q in enumerate(SIGNS):
            if len(code) < q:
                return
            for k in range(last, q):
                out = (out[: len(code) - k] ^ code[k:]) * np.uint32(0x9E3779B1)
                out ^= out >> np.uint32(15)
            last = q
            yield s, q, out


def most_unmatched(n, m, least: float):
    """Letters of a text of n letters that one of m letters leaves unmatched at most, if they match to the ratio."""
    return n - least * (m + n) / 2 + 1e-6


def signs(texts: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of each text as the second of a comparison, which texts have too few, and (text, start, end) of its spans that can have a loss, the longest first.

    difflib takes the letters of a text of 200 and more that are above one in a
    hundred for popular; every matching block has a letter that isn't, an
    anchor, or lies at the start of both texts.  So what is matched of a span
    between two anchors is in one block with either.  Its signs are the run
    that begins with the first anchor and the one that ends with the second: a
    text with neither leaves all letters of the span unmatched but those of
    almost two signs, which is the loss of the span.  As what a text can leave
    unmatched is bounded, so are the losses of the spans of which it has no sign.
    Rare signs are taken, as counted among these texts; that changes the work only.
    """
    code, ends = laid(texts)
    sizes = np.diff(ends) - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    letters = np.unique(code)
    which = owner * len(letters) + np.searchsorted(letters, code[:-1])
    common = np.bincount(which, minlength=len(texts) * len(letters)) > np.repeat(np.where(sizes >= POPULAR, sizes // 100 + 1, np.iinfo(np.int64).max), len(letters))
    anchor = np.append(~common[which], True)
    anchor[ends] = True
    at = np.flatnonzero(anchor)
    span = np.flatnonzero(np.diff(at) - 1 >= SIGNS[0])
    first, last = at[span], at[span + 1]
    starts, stops = code[first] == _SEP, code[last] == _SEP  # of the text: no anchors, and the end has no sign
    best, chosen = np.full(len(span), np.inf), np.zeros((4, len(span)), np.int64)  # place in SIGNS, loss, numbers of both signs
    for s, q, run in numbered(code):
        loss = last - first - 1 - np.where(starts, q - 1, q - 2) - np.where(stops, 0, q - 2)
        some = np.flatnonzero(loss > 0)
        left = run[first[some] + starts[some]]
        right = np.where(stops[some], left, run[np.minimum(last[some] - (q - 1), len(run) - 1)])
        seen = np.bincount(run >> np.uint32(32 - _BINS), minlength=1 << _BINS)
        score = (seen[left >> np.uint32(32 - _BINS)] + seen[right >> np.uint32(32 - _BINS)]) / loss[some]
        better = score < best[some]
        some = some[better]
        best[some] = score[better]
        chosen[:, some] = np.stack([np.full(len(some), s), loss[some], left[better], right[better]])
    used = np.flatnonzero(np.isfinite(best))
    used = used[np.lexsort((best[used], owner[first[used]]))]
    own, loss = owner[first[used]], chosen[1, used]
    before = np.cumsum(loss) - loss
    before -= before[np.searchsorted(own, own)]
    bound = most_unmatched(sizes, sizes * (least / (2 - least)), least)
    unsure = np.bincount(own, loss, minlength=len(texts)) <= bound + 1
    kept = (before <= ENOUGH * bound[own]) & ~unsure[own]
    used, own, loss, before = used[kept], own[kept], loss[kept], before[kept]
    rows, q = np.empty((2, len(used)), SIGN), np.array(SIGNS)[chosen[0, used]]
    for side, place in enumerate((first[used] + starts[used], last[used] - (q - 1))):
        rows[side]["size"], rows[side]["loss"], rows[side]["run"] = chosen[0, used], loss, chosen[2 + side, used]
        rows[side]["text"], rows[side]["before"], rows[side]["place"] = own, before, place - ends[own] - 1
    wide = np.lexsort((first - last, owner[first]))
    begin = ends[owner[first[wide]]] + 1
    spans = np.stack([owner[first[wide]], first[wide] + 1 - begin, last[wide] - begin]).astype(np.int32)
    return np.concatenate([rows[0], rows[1][~stops[used]]]), unsure, spans


def columns(rows: np.ndarray, spans: np.ndarray) -> list[np.ndarray]:
    """Signs and spans as they are sent: by column."""
    return [np.ascontiguousarray(rows[c]) for c in SIGN.names] + list(spans)


def joined(some: list[list[np.ndarray]], texts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signs and spans of blocks that have so many texts, as those of all texts in a row."""
    first = np.cumsum(texts) - texts
    rows = np.empty(sum(len(own[0]) for own in some), SIGN)
    for i, name in enumerate(SIGN.names):
        rows[name] = np.concatenate([own[i] + n if name == "text" else own[i] for own, n in zip(some, first)])
    i = len(SIGN.names)
    return rows, np.stack([np.concatenate([own[i] + n for own, n in zip(some, first)]), *(np.concatenate([own[k] for own in some]) for k in (i + 1, i + 2))])


def without(first: str, second: str, spans: list[list[int]], least: float) -> bool:
    """Whether a text lacks the signs of so many spans of the second that they can't match to the ratio."""
    q, can = SIGNS[0], len(second) - least * (len(first) + len(second)) / 2 + 1e-6
    for start, end in spans:
        loss = end - start - (q - 2 + (start == 0)) - (end < len(second)) * (q - 2)
        if loss > 0 and (second[start : start + q] if start == 0 else second[start - 1 : start + q - 1]) not in first and (end == len(second) or second[end - q + 1 : end + 1] not in first):
            can -= loss
            if can < 0:
                return True
    return False


class Index:
    """Texts by their signs, to be found by the runs of others."""

    def __init__(self, keys: list, texts: list[str], rows: np.ndarray, spans: np.ndarray, least: float):
        self.keys, self.texts, self.least, self.spans = keys, texts, least, {}
        self.wide, self.wide_at = spans[1:], np.searchsorted(spans[0], np.arange(len(texts) + 1))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.by_key, self.rank = [keys[i] for i in order], np.empty(len(keys), np.int64)
        self.rank[order] = np.arange(len(keys))
        self.sizes = np.array([len(t) for t in texts])
        n = self.sizes[rows["text"]]
        #: The longest text for which a sign counts: the losses before it are ENOUGH times what that text can leave unmatched.
        till = (n * (1 - least / 2) + 1 - rows["before"] / ENOUGH) * (2 / least)
        order = np.lexsort((rows["place"], rows["run"], rows["size"]))
        self.rows, self.till, self.n = {c: rows[c][order] for c in SIGN.names}, till[order].astype(np.float32), n[order].astype(np.int32)
        self.span, one = np.unique(rows["text"].astype(np.int64) << 32 | rows["before"], return_index=True)
        self.after = rows["before"][one] + rows["loss"][one]

    def alike(self, keys: list, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(place of one of the texts, of one of the index with a lesser key) that may match to the ratio, the index's being the second of the comparison: none that does is left out, but of texts without signs."""
        lesser = np.array([bisect.bisect_left(self.by_key, key) for key in keys])
        code, ends = laid(texts)
        sizes, far = np.diff(ends) - 1, (2 - self.least) / self.least
        near = np.flatnonzero((self.till >= sizes.min() - 1) & (self.n <= sizes.max() * far + 1))
        rows, found = {c: values[near] for c, values in self.rows.items()}, []
        parts = np.searchsorted(rows["size"], np.arange(len(SIGNS) + 1))
        for s, _, run in numbered(code):
            low, high = parts[s : s + 2]
            if low == high:
                continue
            own = rows["run"][low:high]
            there = np.zeros(1 << _THERE, bool)
            there[own >> np.uint32(32 - _THERE)] = True
            at = np.flatnonzero(there[run >> np.uint32(32 - _THERE)])
            at = at[np.argsort(run[at])]  # neighbours are looked up together
            one = np.minimum(np.searchsorted(ends, at, "right") - 1, len(texts) - 1)
            place, m, mark = at - ends[one] - 1, sizes[one], run[at].astype(np.uint64) << np.uint64(32)
            order = (own.astype(np.uint64) << np.uint64(32)) + rows["place"][low:high].astype(np.uint64)
            # A matched run is as far from its place as letters before it can be unmatched.
            least = np.searchsorted(order, mark + np.maximum(0, place - most_unmatched(m, m / far, self.least)).astype(np.uint64))
            most = np.searchsorted(order, mark + (np.maximum(0, place) + most_unmatched(m * far, m, self.least)).astype(np.uint64), "right")
            hit = least < most
            found.append(np.stack([one[hit], place[hit], low + least[hit], most[hit] - least[hit]]))
        if not found:
            return
        found = np.concatenate(found, axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
        heads = np.searchsorted(found[0], np.arange(len(texts) + 1))
        hits = np.concatenate([[0], np.cumsum(found[3])])[heads]
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(hits, hits[a] + HITS, "right")) - 1)
            yield from self._alike(rows, found[:, heads[a] : heads[b]], sizes, lesser)
            a = b

    def _alike(self, rows: dict[str, np.ndarray], found: np.ndarray, sizes: np.ndarray, lesser: np.ndarray) -> Iterator[tuple[int, int]]:
        one, place, start, count = found
        which = np.repeat(np.arange(len(one)), count)
        at = np.arange(len(which)) + (start - np.cumsum(count) + count)[which]
        text, one = rows["text"][at], one[which]
        own = np.flatnonzero(self.rank[text] < lesser[one])
        at, one, text = at[own], one[own], text[own]
        m, n, moved, before = sizes[one], self.sizes[text], place[which[own]] - rows["place"][at], rows["before"][at]
        whole = self.least / 2 * (m + n) - 1e-6  # letters that are matched at least
        fit = np.flatnonzero((m >= whole) & (before <= ENOUGH * (n - whole)) & (moved <= m - whole) & (-moved <= n - whole))
        if not len(fit):
            return
        pair, before, loss = one[fit] * len(self.sizes) + text[fit], before[fit], rows["loss"][at[fit]]
        order = np.lexsort((before, pair))
        pair, before, loss = pair[order], before[order], loss[order]
        new = np.append(True, pair[1:] != pair[:-1])
        head = np.flatnonzero(new)
        had = np.add.reduceat(np.where(new | np.append(True, before[1:] != before[:-1]), loss, 0), head)  # a span counts once
        one, other = np.divmod(pair[head], len(self.sizes))
        can = most_unmatched(self.sizes[other], sizes[one], self.least)
        last = np.searchsorted(self.span, (other << 32) + (ENOUGH * can).astype(np.int64), "right") - 1
        good = self.after[last] - had <= can
        yield from zip(one[good].tolist(), other[good].tolist())

    def ratios(self, keys: list, texts: list[str]) -> Iterator[tuple]:
        """(lesser key, greater key, their texts, ratio) of the index's texts and others of greater keys that match to the ratio, the greater key's text being the first of the comparison."""
        matcher = difflib.SequenceMatcher(None)
        for x, y in self.alike(keys, texts):
            s, t = self.texts[y], texts[x]
            if y not in self.spans:
                self.spans[y] = self.wide[:, self.wide_at[y] : self.wide_at[y + 1]].T.tolist()
            if not without(t, s, self.spans[y], self.least):
                matcher.set_seqs(t, s)
                ratio = matcher.ratio()
                if ratio >= self.least:
                    yield self.keys[y], keys[x], s, t, ratio
