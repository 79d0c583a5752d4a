"""Problem 4: personal information in free text, by weak supervision.

Patterns propose spans; labelers (shape patterns, a gazetteer of name parts,
context words) vote for or against each, or abstain.  How often each pattern
of votes occurs is counted over all spans; expectation-maximisation estimates
the labelers' reliabilities and each pattern's probability from those counts.
With these probabilities as labels, a logistic regression over votes, context
words and shape is fitted to a bounded sample of spans; it decides on every
span.

A placeholder takes the place of the span only; all other characters stay.
Null and empty texts have no spans.  Lists below are fixed values.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded

TYPES = ("email", "phone", "id_number", "address", "person_name")
SAMPLE = 20_000  # most spans to which the classifier is fitted
CONTEXT_BITS = 10

_LOCAL = r"[A-Za-z0-9](?:[\w.+%'-]*[A-Za-z0-9_])?"
_DOT = r"(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)"
_AT = r"(?: ?[\[({] ?at ?[\])}] ?| ?@ ?)"
EMAIL = re.compile(rf"(?i)(?<![\w.+%@/-]){_LOCAL}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+|(?<![\w.+%@/-]){_LOCAL} at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")
PHONE = re.compile(r"(?i)(?<![\w.@+/-])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){0,4}\d?(?:,? ?(?:ext|extension|x)\.? ?\d{1,6})?(?![\w@/-]|\.\d)|(?<![\w.@+/-])\d{10}(?:,? ?(?:ext|extension|x)\.? ?\d{1,6})?(?![\w@-]|\.\d)")
NUMBER = re.compile(r"(?<![\w.@+/-])(?:[A-Z]{1,3}\d{6,9}[A-Z]?|[a-z]{2}\d{7}|\d{6,9}[A-Za-z]|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}[-+]\d{3,5}|\d{2,3}(?:[. ]\d{3}){2,3}(?:-\d{1,2})?|\d{2}(?: \d{2,3}){3,5}|\d{8,12})(?![\w@/-]|\.\d)")
_STREETS = "weg|straße|strasse|str\\.|gasse|platz|allee|damm|ufer|ring|stieg|steig"
_BEFORE = "rue|avenue|boulevard|place|quai|chemin"
_SPANISH = "Calle|Avenida|Plaza|Paseo"
_KIND = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Terrace|Boulevard|Blvd|Drive|Court|Ct|Way|Place|Pl|Square|Sq|Row|Quay|Crescent|Gardens|Grove|Mews|Parade|Highway|Parkway|Walk|Hill|Gate)"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor)\.? ?#?[0-9A-Z]{1,6}"
_W = r"[A-ZÀ-Ý][\w'’-]*"
_TOWN = rf"(?:(?:North|South|East|West|New|Old|Lake|Port|San|Santa|Saint|St\.|Fort|Mount|Bad|Great|Little|Upper|Lower|Cape|Los|Las|El|La|Le) {_W}|{_W} (?:Quay|Hythe|City|Falls|Springs|Beach|Bay|Park|Hill|Hills|Heights|Valley|Grove|Harbour|Harbor|Cross|Green|Common|Heath|Bridge|Mills|Rapids|Point)\b|{_W} {_W}(?=,? \d{{4,6}}\b)|{_W})"
_PLACE = rf"(?:, {_UNIT})?(?:, {_TOWN}(?:,? \d{{4,6}}(?![\w-]))?)?"
ADDRESS = re.compile(
    rf"(?:{_UNIT},? )?(?<![\w.-])\d{{1,5}}[A-Za-z]?,? (?:{_W} ){{1,3}}{_KIND}\b\.?{_PLACE}"
    rf"|P\.? ?O\.? Box \d+(?:, {_TOWN}(?:,? \d{{4,6}}(?![\w-]))?)?"
    rf"|(?<![\w-])(?:{_W} ){{0,2}}[A-ZÀ-Ý][\w-]*(?:{_STREETS}) \d{{1,4}}[a-z]?(?:, {_UNIT})?(?:, (?:\d{{4,6}} )?{_TOWN})?"
    rf"|(?<![\w-])\d{{1,4}},? (?:{_BEFORE}) (?:de |du |des |la |le )*{_W}(?: {_W})?(?:, (?:\d{{4,6}} )?{_TOWN})?"
    rf"|(?:{_SPANISH}) (?:de |del |la )*{_W}(?: {_W})?,? \d{{1,4}}(?:, (?:\d{{4,6}} )?{_TOWN})?",
)
_ADDRESS_ANY = re.compile(ADDRESS.pattern, re.IGNORECASE)

_NAME = r"[^\W\d_](?:[\w'’]|-(?=\w))*"
_INITIAL = r"[A-Za-zÀ-Ý]\."
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme|Sra?|Sir|Dame)\.? )?"
_LEADS = r"ask|customer|client|patient|spoke with|met with|talked to|my name is|i am|this is|contact for [^:.\n]{1,40}:|from:|to:|owner:|name=|name:|author:|assignee:|signed,?|approved by|written by|reviewed by|dear|thanks for the help,|thank you,?|regards,?|cheers,?|sincerely,?|by"
_FIELDS = "owner|name|user|author|assignee"
_TITLES = "Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme|Sra"
_FOLLOWS = "can be reached|signed the|wants to|last week"
LED = re.compile(rf"(?i)\b(?:{_LEADS})\s+{_TITLE}(?=[^\W\d_])|\b(?:{_FIELDS})=(?=[^\W\d_])|\b(?:{_TITLES})\.? (?=[^\W\d_])")
_WEAK = re.compile(r"(?i)(?:by|ask|to:|this is|i am|dear)\s+$")
FOLLOWED = re.compile(r"(?i)(?: \(\x00+\))? (?:" + _FOLLOWS + r")\b| [<(]\x00")
_TOKEN = re.compile(rf"{_INITIAL}(?! ?[a-z]{{2}})|{_NAME}")

NUMBER_WORDS = "passport|identity|national id|tax number|tax id|tin|ssn|social security|citizen|person_?id|personal (?:id|number)|id card|driver|licen[cs]e no|nif|dni|bsn"
THING_WORDS = "invoice|part|checksum|epoch|ticket|version|commit|build|range|port|order|serial|tracking|dataset|sku|batch|account|page|table|row|release|revision|transaction|reference|case|lot|model|item|shard|timestamp|since|hash"
CALL_WORDS = "call|ring|text|phone|tel|telephone|fax|voice|mobile|cell|line|reach|reached|contact|dial|from|number|sms|whatsapp|reply"
HOME_WORDS = "address|moved to|live|lives|visit|ship|delivery|deliver|send|lists|residence|resident|mail|located|house|home"
_NUMBER_NEAR, _THING_NEAR, _CALL_NEAR, _HOME_NEAR = (re.compile(rf"(?i)(?:^|[^A-Za-z])(?:{x})") for x in (NUMBER_WORDS, THING_WORDS, CALL_WORDS, HOME_WORDS))
COMMON = frozenset("the a an and or for to of in on at by with from as if when while because since until unless why what which who whom whoever how this that these those it its they we you he she i is are was were be been has have had do does did can could will would should may might must not no nobody most people about after before again all any each every once please even then though although so but there here our your their my his her more most next other same some such than too very just only own last first second another once during where however also team crew list give write explain compare summarize calling nothing everyone anyone someone somebody anybody operator planner reviewer engineer steward worker owner agent script job check name contact customer regards help thanks ask from dear by later first again mistake".split())

#: The labelers of each type, in the order of their votes.
LABELERS = {
    "email": ("domain", "spelled", "name in it", "path follows", "service", "context"),
    "phone": ("grouped 3-3-4", "international", "extension", "call word", "digits", "number of a person", "number of a thing", "fictional range", "shape of an id"),
    "id_number": ("id word", "thing word", "call word", "letters", "id shape", "ten digits"),
    "address": ("postcode", "unit", "home word", "street", "box", "bare"),
    "person_name": ("given", "family", "led", "followed", "initial or comma", "common word", "lower case alone", "single", "capitals", "known in context", "sure lead"),
}


class Gazetteer:
    def __init__(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = frozenset(x.lower() for x in given), frozenset(x.lower() for x in family)
        self.patterns = self._patterns()  # apart, as RE2 is slow on one of that size

    def compiled(self) -> str:
        """One RE2 pattern of all texts that may hold any span."""
        return "|".join(f"(?:{p})" for p in self.patterns)

    def _patterns(self) -> list[str]:
        """RE2 patterns; every text that holds a span matches one of them.

        They come from the lists of the operator's own patterns, without what
        only narrows these.  RE2's \\d, \\s, \\w and \\b know ASCII only, hence the classes.
        """
        edge, space = r"(?:^|[^\p{L}\p{N}_])", r"[\p{Z}\x00-\x20\x{85}]"
        led = rf"(?i:{edge}(?:{_folded(_LEADS)}){space}+{_folded(_TITLE)}|{edge}(?:{_folded(_FIELDS)})=|{edge}(?:{_folded(_TITLES)})\.? )"
        out = [
            r"@|(?i:[\[({] ?at ?[\])}]| at \S+ dot )|[<(]\x00",
            r"\p{Nd}(?:[ .()+-]{0,3}\p{Nd}){6}",
            rf"(?i:box \p{{Nd}}|(?:{_folded(_STREETS)}) \p{{Nd}}|\p{{Nd}},? (?:{_folded(_BEFORE)}) |(?:{_folded(_SPANISH)}) )",
            rf"\p{{Nd}}\p{{L}}?,? (?:[\p{{L}}×÷][^ ]* ){{1,3}}(?i:{_folded(_KIND)})(?:[^\p{{L}}\p{{N}}_]|$)",
            rf"(?i: (?:{_folded(_FOLLOWS)}))",
            rf"{led}[^\p{{Ll}}\p{{Lo}}\p{{Nd}}_]",  # a word after a lead is taken if it begins large,
            rf"^[^\p{{Lu}}\p{{Lt}}]*{led}[^\p{{Lu}}\p{{Lt}}]*$",  # or in a text without large letters
        ]
        parts = "|".join(_folded(re.escape(x).replace("\\-", "-")) for x in sorted(self.given | self.family))
        return [*out, rf"(?i:(?:^|[^\p{{L}}])(?:{parts})(?:[^\p{{L}}\p{{N}}_]|$))"] if parts else out

    def triggered(self, texts: pa.Array) -> pa.Array:
        """Whether a text may hold a span."""
        out = pc.match_substring_regex(texts, self.patterns[0])
        for pattern in self.patterns[1:]:
            out = pc.or_(out, pc.match_substring_regex(texts, pattern))
        return out


def _folded(pattern: str) -> str:
    """For RE2, which doesn't take dotless and dotted i for equal as Python does."""
    return re.sub("[iI]\u0307?", lambda m: "[iıİ]" if len(m.group()) == 1 else "(?:[iıİ]\u0307|İ)", pattern)


_CLAUSE = re.compile(r"(?<!\bno)(?<!\bNo)(?<!\bDr)(?<!\bSt)(?<!\bnr)[.?!] |\n")

Span = tuple[str, int, int, tuple[int, ...]]


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before a span within its clause, and those after it."""
    left = text[max(0, start - 48) : start]
    cut = max((m.end() for m in _CLAUSE.finditer(left)), default=0)
    return left[cut:], text[end : end + 24]


def spans(text: str, names: Gazetteer) -> list[Span]:
    """All candidates of a text with their votes; of two that overlap the first in the order of types stays."""
    out: list[Span] = []
    taken = bytearray(len(text))

    def add(kind: str, start: int, end: int, votes: tuple) -> None:
        out.append((kind, start, end, tuple(int(v) for v in votes)))
        taken[start:end] = b"\1" * (end - start)

    for m in EMAIL.finditer(text):
        start, end = m.span()
        found = m.group()
        left, right = _near(text, start, end)
        local = re.split(r"(?i)[@\[({]| at ", found)[0].strip().lower()
        parts = set(re.split(r"[^a-zà-ÿ]+", local))
        follows = bool(re.match(r"[:/]\S", right))
        known = any(p[k:] in names.family or p[k:] in names.given for p in parts for k in (0, 1))
        service = local in {"git", "svn", "hg", "root", "ssh", "cvs"}
        add("email", start, end, (1 if re.search(r"(?i)(?:\.|dot[\])}]?) ?[a-z]{2,}$", found) else -1, 1 if re.search(r"(?i)\bat\b|[ ]", found) else 0, 1 if known else 0, -1 if follows else 0, -1 if service else 0, -1 if re.search(r"(?i)clone|ssh|://|remote add", left) else 0))

    work = text if not out else "".join("\0" if t else c for c, t in zip(text, taken))
    for m in (ADDRESS if not text.isupper() and not text.islower() else _ADDRESS_ANY).finditer(work):
        start, end = m.span()
        found = m.group()
        if found.endswith(".") and not re.search(r"(?i)\b(?:st|rd|ave|blvd|ln|ct|pl|sq|str)\.$", found):
            end -= 1
            found = found[:-1]
        left, _ = _near(text, start, end)
        after = text[start - 0 : end + 40]
        home = bool(_HOME_NEAR.search(left)) or "place of delivery" in after
        code, unit, box = bool(re.search(r"\b\d{4,6}$|, \d{4,6} ", found)), bool(re.search(_UNIT, found)), bool(re.match(r"(?i)p\.? ?o", found))
        add("address", start, end, (1 if code else 0, 1 if unit else 0, 1 if home else -1, 1 if re.search(rf"\d+ (?:{_W} )+{_KIND}", found) or re.search(r"(?:weg|straße|gasse|platz|allee) \d", found) else 0, 1 if box else 0, -1 if not (code or unit or box or "," in found) else 0))

    work = "".join("\0" if t else c for c, t in zip(text, taken)) if out else text
    numbers: list[tuple[int, int]] = sorted({m.span() for p in (PHONE, NUMBER) for m in p.finditer(work)}, key=lambda s: (s[0] - s[1], s[0]))
    for start, end in numbers:
        if any(taken[start:end]):
            continue
        found = work[start:end]
        digits = re.sub(r"\D", "", re.split(r"(?i),? ?(?:ext|x)", found)[0])
        if len(digits) < 7:
            continue
        left, right = _near(text, start, end)
        person, thing, call = (bool(p.search(left[-34:])) for p in (_NUMBER_NEAR, _THING_NEAR, _CALL_NEAR))
        call = call or bool(re.match(r",? ask for|\)? ?signed", right)) or left[-1:] in "<("
        international, extension = bool(re.match(r"\+|00\d{1,3}[ -]", found)), bool(re.search(r"(?i)(?:ext|x)\.? ?\d+$", found))
        grouped = bool(re.match(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}(?:\D|$)", found))
        shaped = bool(re.fullmatch(r"[A-Za-z]{1,3}\d{6,9}[A-Za-z]?|\d{6,9}[A-Za-z]|\d{3}-\d{2}-\d{4}|\d{6}[-+]\d{3,5}|\d{3}(?:\.\d{3}){2}-\d{2}", found))
        fiction = bool(re.search(r"555\D?01\d\d", found))
        if not shaped and (international or extension or grouped) or (len(digits) == 10 and found.isdigit() and not person) or (call and not shaped and not person):
            size = -1 if not 7 <= len(digits) <= 15 else 1 if grouped or international else 0
            add("phone", start, end, (1 if grouped else 0, 1 if international else 0, 1 if extension else 0, 1 if call else 0, size, -1 if person else 0, -1 if thing else 0, 1 if fiction else 0, -1 if shaped else 0))
        else:
            letters = bool(re.match(r"[A-Za-z]|.*[A-Za-z]$", found))
            add("id_number", start, end, (1 if person else -1, -1 if thing else 0, -1 if call else 0, 1 if letters else 0, 1 if shaped else 0, -1 if len(digits) == 10 and found.isdigit() else 0))

    work = "".join("\0" if t else c for c, t in zip(text, taken)) if out else text
    style = text.isupper() or text.islower()
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(work)]
    begins, ends = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i for i, t in enumerate(tokens)}
    found_names: dict[tuple[int, int], list[int]] = {}
    sure: set[int] = set()

    def propose(source: int, first: int, last: int, anchor: int | None, certain: bool = False) -> None:
        if (span := _trimmed(work, tokens, first, min(last, len(tokens) - 1), anchor, names, style, source, certain)) is not None:
            found_names.setdefault(span, [0, 0, 0])[source] = 1
            if certain:
                sure.add(span[0])

    for m in LED.finditer(work):
        if (i := begins.get(m.end())) is not None:
            propose(0, i, i + 3, None, not _WEAK.match(m.group()))
    for m in FOLLOWED.finditer(work):
        if (i := ends.get(m.start())) is not None:
            propose(1, max(0, i - 2), i, None, bool(re.search(r"(?i)can be reached|signed the", m.group())))
    for i, (_, _, w) in enumerate(tokens):
        if (w.lower() in names.given or w.lower() in names.family) and work[tokens[i][0] - 1 : tokens[i][0]] not in ("@", "_", ".", "+"):
            propose(2, max(0, i - 2), i + 2, i)
    for (start, end), sources in sorted(found_names.items(), key=lambda x: (x[0][0] - x[0][1], x[0][0])):
        if any(taken[start:end]):
            continue
        own = work[start:end]
        words = re.findall(_NAME, own)
        long = [w.lower() for w in words if len(w) > 1]
        given, family = any(w in names.given for w in long), any(w in names.family for w in long)
        strong = start in sure
        led, followed, single = sources[0], sources[1] if sources[1] and not work.startswith(" last", end) or sources[0] else 0, len(words) == 1
        add("person_name", start, end, (
            given, family, led, followed, 1 if re.search(r"\b[A-Za-z]\.|, ", own) else 0, -1 if any(w in COMMON for w in long) else 0, -1 if own.islower() and not style and not (given and family) and not led else 0,
            (0 if strong or (given or family) and (led or followed) else -1) if single else 1, 1 if len(long) > 1 and all(w[0].isupper() for w in words) else 0, (given or family) and (led or followed), strong,
        ))
    return out


def _trimmed(text: str, tokens: list[tuple[int, int, str]], first: int, last: int, anchor: int | None, names: Gazetteer, style: bool, source: int, certain: bool) -> tuple[int, int] | None:
    """The span around a known part (or where a context leads) that can be a name: at most two words and initials."""

    def known(w: str) -> bool:
        return w.lower() in names.given or w.lower() in names.family

    def initial(w: str) -> bool:
        return len(w) == 2 and w[1] == "."

    def fits(w: str) -> bool:
        return known(w) or initial(w) and (w[0].isupper() or style) or w.lower() not in COMMON and (w[0].isupper() or style)

    if anchor is None:
        anchor = next((i for i in (range(first, last + 1) if source == 0 else range(last, first - 1, -1)) if known(tokens[i][2])), None)
        edge = first if source == 0 else last
        if anchor is not None and anchor != edge:
            low, high = min(anchor, edge), max(anchor, edge)
            if high - low > 2 or any(text[tokens[i][1] : tokens[i + 1][0]] not in (" ", "", ", ") for i in range(low, high)) or any(not fits(t[2]) and (t[2].lower() in COMMON or not t[2].islower()) for t in tokens[low : high + 1]):
                anchor = None
        if anchor is None:
            anchor = edge
        if not fits(tokens[anchor][2]):
            return None
    lower = tokens[anchor][2].islower() and not style
    led = source < 2

    def joins(i: int, left: int, right: int) -> bool:
        w, gap = tokens[i][2], text[tokens[left][1] : tokens[right][0]]
        if gap not in (" ", "", ", ") or gap == ", " and not (certain and source == 0 and fits(w) or known(w) or known(tokens[left if i == right else right][2]) or initial(w)):
            return False
        return fits(w) and (not lower or known(w) or initial(w)) or lower and led and w.islower() and w not in COMMON

    def whole(a: int, b: int) -> int:
        return sum(not initial(t[2]) for t in tokens[a : b + 1])

    a = b = anchor
    while a > first and joins(a - 1, a - 1, a) and (initial(tokens[a - 1][2]) or whole(a, b) < 2):
        a -= 1
    while b < last and joins(b + 1, b, b + 1):
        gap = text[tokens[b][1] : tokens[b + 1][0]]
        if not initial(tokens[b + 1][2]) and whole(a, b) >= 2 or gap == ", " and whole(a, b) >= 2:
            break
        if initial(tokens[b + 1][2]) and whole(a, b) >= 2 and ", " not in text[tokens[a][0] : tokens[b][1]]:
            break
        b += 1
    if a == b and initial(tokens[a][2]):
        return None
    return tokens[a][0], tokens[b][1]


def _context(text: str, start: int, end: int, kind: str) -> list[int]:
    """Hashes of the two words before a span and of the two after it."""
    left = re.findall(r"[^\W\d_]+|[^\w\s]", text[max(0, start - 30) : start])[-2:]
    right = re.findall(r"[^\W\d_]+|[^\w\s]", text[end : end + 24])[:2]
    words = [f"{kind} {side} {w.lower()}" for side, ws in (("l", left), ("r", right)) for w in ws]
    return [zlib.crc32(w.encode()) & ((1 << CONTEXT_BITS) - 1) for w in words]


SPANS = "tbl string, row_id string, part int, start int, end int, pii_type string, found_text string, votes string, context array<int>"


def proposed(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Candidate spans of (tbl, row_id, part, text), with votes as a string and context features."""
    rows = names.filter("name_part is not null").select("name_part", "kind").distinct().collect()  # a list of name parts, small by nature
    gazetteer = Gazetteer([r["name_part"] for r in rows if r["kind"] == "given"], [r["name_part"] for r in rows if r["kind"] != "given"])
    shared = texts.sparkSession.sparkContext.broadcast(([*gazetteer.given], [*gazetteer.family]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gazetteer(*shared.value)
        for batch in batches:
            batch = batch.filter(own.triggered(batch.column(3)))
            out: list[tuple] = []
            for tbl, row, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, start, end, votes in spans(text, own):
                    out.append((tbl, row, part, start, end, kind, text[start:end], ",".join(map(str, votes)), _context(text, start, end, kind)))
            columns = list(zip(*out)) if out else [()] * 9
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["tbl", "row_id", "part", "start", "end", "pii_type", "found_text", "votes", "context"])

    return texts.filter("row_id is not null and text is not null and text <> ''").select("tbl", "row_id", F.col("part").cast("int"), "text").mapInArrow(run, SPANS)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Probability of each pattern of votes to be a true span, from the patterns' counts, by expectation-maximisation.

    Votes are taken as independent given the truth; a labeler begins as better
    than chance in the direction of its vote.
    """
    votes = np.array([[int(v) for v in p.split(",")] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    belief = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    prior = np.array([[6.0, 2.0, 1.0], [1.0, 2.0, 6.0]])  # pseudo-counts of the votes -1, 0, 1 for false and true spans
    for _ in range(rounds):
        share = np.clip((n * belief).sum() / n.sum(), 0.02, 0.98)
        score = np.log([1 - share, share])[None, :].repeat(len(n), 0)
        for j in range(votes.shape[1]):
            table = np.stack([[((n * w) * (votes[:, j] == v)).sum() for v in (-1, 0, 1)] for w in (1 - belief, belief)]) + prior[::1] * [[1], [1]]
            table /= table.sum(axis=1, keepdims=True)
            score += np.log(table[:, votes[:, j] + 1]).T
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(new - belief).max() < 1e-5:
            break
        belief = new
    return {p: float(b) for (p, _), b in zip(patterns, belief)}


class SpanClassifier:
    """Logistic regression over votes and context words, for one type of span."""

    def __init__(self, votes: int) -> None:
        self.votes, self.weights = votes, np.zeros(1 + 2 * votes + (1 << CONTEXT_BITS))

    def matrix(self, votes: list[str], context: list[list[int]]) -> np.ndarray:
        v = np.array([[int(x) for x in p.split(",")] for p in votes]).reshape(len(votes), self.votes)
        x = np.zeros((len(votes), len(self.weights)), np.float32)
        x[:, 0] = 1
        x[:, 1 : 1 + self.votes], x[:, 1 + self.votes : 1 + 2 * self.votes] = v > 0, v < 0
        for i, ids in enumerate(context):
            x[i, 1 + 2 * self.votes + np.array(ids, int)] = 0.5
        return x

    def fit(self, votes: list[str], context: list[list[int]], target: np.ndarray, steps: int = 150, penalty: float = 2.0) -> None:
        x = self.matrix(votes, context)
        square = np.full(len(self.weights), 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            g = x.T @ (p - target) / len(target) + penalty / len(target) * self.weights
            square += g * g
            self.weights -= 0.3 * g / np.sqrt(square)

    def probability(self, votes: list[str], context: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.matrix(votes, context) @ self.weights, -30, 30)))


def found(spans: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The spans that the classifier takes for personal information."""
    counts = spans.groupBy("pii_type", "votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** labelers rows a type
    true = {kind: reliabilities(own) for kind in TYPES if (own := sorted((r["votes"], r["n"]) for r in counts if r["pii_type"] == kind))}
    drawn = bounded(spans.select("tbl", "row_id", "part", "start", "pii_type", "votes", "context"), ["tbl", "row_id", "part", "start"], sample)
    models: dict[str, SpanClassifier] = {}
    for kind in true:
        own = [r for r in drawn if r["pii_type"] == kind]
        models[kind] = SpanClassifier(len(LABELERS[kind]))
        if own:
            models[kind].fit([r["votes"] for r in own], [r["context"] for r in own], np.array([true[kind][r["votes"]] for r in own]))
    shared = spans.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                kinds, votes, context = (part.column(c).to_pylist() for c in ("pii_type", "votes", "context"))
                keep = np.zeros(part.num_rows, bool)
                for kind, model in shared.value.items():
                    own = [i for i, k in enumerate(kinds) if k == kind]
                    if own:
                        keep[own] = model.probability([votes[i] for i in own], [context[i] for i in own]) >= least
                yield part.filter(pa.array(keep))

    return spans.mapInArrow(run, SPANS).drop("votes", "context")


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(tbl, row_id, part, text) with [TYPE] in the place of each span."""
    places = spans.groupBy("tbl", "row_id", "part").agg(F.sort_array(F.collect_set(F.struct("start", "end", "pii_type"))).alias("places"))
    joined = texts.join(places, ["tbl", "row_id", "part"], "left")
    step = F.aggregate(
        "places", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, p: F.struct(F.concat(s["done"], F.substring("text", s["at"] + 1, p["start"] - s["at"]), F.lit("["), F.upper(p["pii_type"]), F.lit("]")).alias("done"), p["end"].alias("at")),
        lambda s: F.concat(s["done"], F.substring("text", s["at"] + 1, F.length("text"))),
    )
    return joined.select("tbl", "row_id", "part", F.when(F.col("places").isNull(), F.col("text")).otherwise(step).alias("text"))
