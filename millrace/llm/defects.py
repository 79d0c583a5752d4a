"""Problem 7: prompt and response pairs that are spoilt.

A response is cut into clauses (sentences, list items, lines of code).  A
conditional random field tags each as answer, refusal, echo, foreign or
unfinished; the coverage of the response by tags gives the pair's defect.

There are no labelled pairs, so labelling rules tag the clauses of a sample
first and the field learns from those tags; it sees more than the rules do
(person, negation, place, overlap, language, how often a word ends a
sentence), and a clause's neighbours count.  How words end sentences is
counted over all distinct pairs, and a pair is judged by the counts of the
others.

Word lists are fixed values.  A null or blank response, or one that only
stands for nothing, has an empty answer.  A null or blank prompt can't be
copied and has no language.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import prose
from . import words as W
from .bits import bitmap, set_in
from .crf import Chain
from .sampling import bounded
from .storage import store

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGGED = 1500  # most pairs that rules tag for the field to learn from

NOTHING = frozenset("none null nil nan na n/a n.a empty blank todo tbd tba undefined missing pending unanswered void".split()) | {"no answer", "no response", "not available", "not applicable", "no content", "no output", "to do", "to be done", "to be determined", "kein", "keine", "sans réponse", "aucune", "ninguna", "ninguno", "sin respuesta", "keine antwort", "answer", "your answer here", "answer here", "insert answer here", "placeholder", "lorem ipsum", "left blank", "intentionally left blank"}
SELF = frozenset("puedo i me my mine myself we us our i'm i'd i'll i've je j'ai me mon mes moi yo mi mí ich mir mich mein meine".split())
NOT = frozenset("not no cannot can't won't don't unable never neither nor refuse decline declining couldn't wouldn't shouldn't isn't aren't mustn't without ne pas no nicht kein keine nie puedo impossible".split())
SORRY = frozenset("sorry apologize apologise apologies apology regret regrets unfortunately désolé désolée siento lamento leid leider malheureusement pardon".split())
HELP = frozenset("help helping assist assisting answer answering discuss discussing talk comfortable permitted allowed inappropriate guidelines policy able go turn leave rather something steps touching provide share comply respond répondre aider ayudar responder helfen beantworten topic subjects".split())
LEAD = frozenset("you asked question answer q a prompt instruction the was is vous avez demandé usted preguntó sie fragten réponse respuesta antwort frage pregunta".split())
TAIL = frozenset("the a an and or but that which who of to in on at by for with from as if when while because since until whenever unless although though than so is are was were be been has have had can could will would should must may might not its their this these those each every very such le la les de du des et ou que qui un une pour par avec sur dans est el los las y o en con por para del al der die das und oder dass ein eine einen mit von für auf wird ist".split())

_REFUSAL = re.compile(
    r"(?i)\b(i|we)('m| am| are)? (can('|’)?t|cannot|can not|am not able|are not able|not able|unable|won('|’)?t|will not|must decline|must refuse|have to decline|have to refuse|have to leave|decline|refuse|do not feel|don('|’)t feel|would rather not|prefer not|am not (permitted|allowed|comfortable)|not (permitted|allowed|comfortable)|turn down)\b(?! say which| tell which)"
    r"|\b(my|our) (guidelines|rules|policy|policies|instructions|purpose) (keep|prevent|forbid|do not|don't|is limited|are limited)"
    r"|\b(inappropriate|outside what i|not something i|one i turn down|from me\b|other than|beyond what i)"
    r"|\b(je ne peux pas|ne puis|no puedo|kann ich nicht|ich kann nicht|nicht helfen|no me es posible|je refuse)\b"
)
_ITEM = re.compile(r"^\s*([-*•]|\d+[.)])\s+")
_BARE = re.compile(r"^\s*([-*•]|\d+[.)])\s*$")
_CUT = re.compile(r"[.!?…。](?:[\"')\]]*\s+(?=\S)|(?<=[.!?])(?=[A-ZÀ-Ý¿¡][a-zà-ÿ]))")  # a part ends with the first of these signs
_SPEECH = {"en": "english anglais englisch inglés", "fr": "french français französisch francés", "es": "spanish espagnol spanisch español", "de": "german allemand deutsch alemán"}
_TONGUES = tuple(_SPEECH)
_ASKED = {w: _TONGUES.index(code) for code, names in _SPEECH.items() for w in names.split()}
_COMMON = {w: _TONGUES.index(k) for k, v in prose.COMMON.items() for w in v if sum(w in other for other in prose.COMMON.values()) == 1}
#: Letters of which every match of _REFUSAL in an ASCII text has some.
_DECLINES = ("i ", "we ", "'m ", "my ", "our ", "inappropriate", "outside what", "from me", "other than", "beyond what", "something i", "one i ", "je ", "ne puis", "no ", "kann ", "nicht helfen")
#: Blanks for what is not of a word, in ASCII texts without apostrophes.
_GAPS = bytes(i if chr(i).isalnum() else 32 for i in range(128)) + bytes(128)
_REFERENCE = re.compile(r"[\w-][./_][\w-]")


def parts(line: str) -> tuple[list[str], bool]:
    """The sentences of a line that isn't code, without blanks around them, and whether it is a list item."""
    bare = line.strip()
    item = _ITEM.match(line) if bare[:1] in "-*•" or bare[:1].isdecimal() else None
    if item:
        bare = line[item.end() :].strip()
    out, at = [], 0
    for cut in _CUT.finditer(bare):
        out.append(bare[at : cut.start() + 1])
        at = cut.end()
    if at < len(bare):
        out.append(bare[at:])
    return out, item is not None


def clauses(text: str) -> list[tuple[str, bool, bool]]:
    """(clause, whether it is code, whether it is a list item) of a response, in order; blank ones are left out."""
    out: list[tuple[str, bool, bool]] = []
    fenced = False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif bare and fenced:
            out.append((bare, True, False))
        elif bare:
            found, item = parts(line)
            out += [(p, False, item) for p in found]
    return out


def last_clause(text: str) -> str | None:
    """The last clause of a response; None if it has none. Without fences only the last lines are looked at."""
    if "```" in text or "~~~" in text:
        found = clauses(text)
        return found[-1][0] if found else None
    end = len(text)
    while end > 0:
        begin = text.rfind("\n", 0, end) + 1
        found, _ = parts(text[begin:end])
        if found:
            return found[-1]
        end = begin - 1
    return None


def words_of(text: str) -> list[str]:
    """What prose.WORDS finds; most texts need no pattern for it."""
    return text.encode().translate(_GAPS).decode().split() if text.isascii() and "'" not in text else prose.WORDS.findall(text)


def spoken(votes: np.ndarray, least: int = 2) -> np.ndarray:
    """The language (column) with most votes of every row; -1 where they are too few or equal."""
    top = votes.max(axis=1, initial=0)
    return np.where((top >= least) & ((votes == top[:, None]).sum(axis=1) == 1), votes.argmax(axis=1), -1)


def refuses(clause: str) -> bool:
    """Whether a clause has a phrase of refusal."""
    low = clause.lower()
    return (not clause.isascii() or any(x in low for x in _DECLINES)) and _REFUSAL.search(clause) is not None


def is_nothing(text: str | None) -> bool:
    """Whether a response is null, blank or only stands for nothing."""
    if text is not None and len(text) > 60 and not text.isspace():
        text = text.strip()
        if len(text) > 60:
            return not re.search(r"\w", text)
    bare = re.sub(r"[^\w/.' ]+|_", " ", text or "").strip().strip(".' ").lower()
    bare = re.sub(r"\s+", " ", "".join(c for c in bare if c.isprintable()))
    return not re.search(r"\w", bare) or bare in NOTHING


class Ends:
    """How often a word, after up to two others, ends a sentence."""

    def __init__(self) -> None:
        self.last: Counter = Counter()
        self.all: Counter = Counter()

    @staticmethod
    def form(words: list[str], skip: int = 0) -> list[str]:
        """Numbers and names within a sentence as # and ^, other words in lower case; the first ``skip`` words are left out."""
        return ["#" if w[0].isdigit() else "^" if w[0].isupper() and i else w.lower() for i, w in enumerate(words) if i >= skip]

    def add(self, clause: str, words: list[str]) -> None:
        w = ["", "", *self.form(words)]
        grams = [tuple(w[i - n : i]) for n in (1, 2, 3) for i in range(3, len(w) + 1)]
        self.all.update(grams)
        if clause[-1:] in ".!?" and words:
            self.last.update(tuple(w[-n:]) for n in (1, 2, 3))

    @classmethod
    def grams(cls, words: list[str]) -> list[tuple[str, ...]]:
        """The last word, the last two and the last three."""
        w = ["", "", *cls.form(words)]
        return [tuple(w[-n:]) for n in (1, 2, 3)]

    def counts(self, words: list[str]) -> list[int]:
        """The counts of the last one, two and three words."""
        return [n for gram in self.grams(words) for n in (self.all[gram], self.last[gram])]


def likely(counts: list[int], capital: bool) -> float:
    """Probability that a sentence may end with words of these counts (see ``Ends.counts``), the last of which is a name or not."""
    p = 0.6 if capital else 0.02
    for n, last in zip(counts[::2], counts[1::2]):
        p = (last + 2 * p) / (n + 2)
    return p


FEATURES = 31


WORDS, CAPITAL, UNKNOWN, DANGLING, LISTED, PLAIN = (1 << i for i in range(6))  # facts of a response's last clause
ENDING = (27, 28, 29)  # features that need counts of all pairs


@dataclass
class Opened:
    """What a pair's own text shows; ``closed`` adds what the counts of all pairs tell of the response's end."""

    bits: np.ndarray
    echo: np.ndarray
    sizes: np.ndarray
    covered: float
    facts: int
    own: list[int]

    def packed(self) -> bytes:
        """A few bytes a clause."""
        head = struct.pack("<IfB6I", len(self.sizes), self.covered, self.facts, *self.own)
        return head + self.sizes.astype("<i4").tobytes() + self.echo.astype("<f4").tobytes() + np.packbits(self.bits, axis=1).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Opened:
        n, covered, facts, *own = struct.unpack_from("<IfB6I", data)
        at = struct.calcsize("<IfB6I")
        sizes, echo = np.frombuffer(data, "<i4", n, at), np.frombuffer(data, "<f4", n, at + 4 * n)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, n * ((FEATURES + 7) // 8), at + 8 * n).reshape(n, -1), axis=1)[:, :FEATURES]
        return cls(bits.astype(bool), echo, sizes, covered, facts, list(own))

    def closed(self, counts: list[int], less: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Features, sizes, the rules' tags and the covered share, given how often the last words occur and end a sentence in all pairs (``less`` this one)."""
        x = self.bits.astype(np.float32)
        x[:, 14] = self.echo
        tags = np.zeros(len(x), np.int64)
        if not len(x):
            return x, self.sizes, tags, self.covered
        others = [max(0, n - m) for n, m in zip(counts, self.own)] if less else counts
        ending = likely(others, bool(self.facts & CAPITAL)) if self.facts & WORDS else 0.5
        dangling = self.facts & DANGLING or self.facts & PLAIN and ending < 0.35 or self.facts & LISTED and self.facts & UNKNOWN and others[0] == 0
        x[:, ENDING[2]] = 1  # within a response nothing ends
        x[-1, ENDING[0]], x[-1, ENDING[1]], x[-1, ENDING[2]] = bool(dangling), ending < 0.1, ending > 0.4
        tags[(x[:, 15] > 0) & (self.sizes > 2) & (x[:, 23] == 0)] = ECHO
        tags[x[:, ENDING[0]] > 0] = UNFINISHED
        tags[x[:, 18] > 0] = FOREIGN
        tags[x[:, 12] > 0] = REFUSAL
        return x, self.sizes, tags, self.covered


_SETS = (SELF, NOT, SORRY, HELP, LEAD, TAIL)
_IN_SETS = {w: sum((w in x) << k for k, x in enumerate(_SETS)) for w in chain(*_SETS)}


class Words(dict):
    """Numbers of words, and what each of them is, looked up once a word."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, and how many each has."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum())), n

    def close(self) -> None:
        """To be called when all words are numbered."""
        low = " ".join(self).lower().split(" ") if self else []
        forms: dict[str, int] = {"": 0}
        ids: dict[str, int] = {}
        whole = lambda values: np.fromiter(values, np.int64, len(low))
        self.low = whole(ids.setdefault(x, len(ids)) for x in low)  # equal for words that differ in capitals only
        self.sets = whole(map(_IN_SETS.get, low, repeat(0)))
        self.tongue = whole(map(_COMMON.get, low, repeat(-1)))
        self.asked = whole(map(_ASKED.get, low, repeat(-1)))
        # See Ends.form: the form of a sentence's first word, and of others.
        self.first = whole(forms.setdefault("#" if w[0].isdigit() else x, len(forms)) for w, x in zip(self, low))
        self.later = whole(forms.setdefault("#" if w[0].isdigit() else "^" if w[0].isupper() else x, len(forms)) for w, x in zip(self, low))
        self.forms = list(forms)

    def formed(self, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the forms of texts of n words, with two zeros before each text, and the words' places there."""
        place = np.arange(len(word)) + 2 * np.repeat(np.arange(1, len(n) + 1), n)
        form = np.zeros(len(word) + 2 * len(n), np.int64)
        form[place] = self.later[word]
        begin = (np.cumsum(n) - n)[n > 0]
        form[place[begin]] = self.first[word[begin]]
        return form, place


@dataclass
class Said:
    """The words of clauses that aren't code: their places among forms (see ``Words.formed``), and whether they end a sentence."""

    form: np.ndarray
    place: np.ndarray
    ends: np.ndarray
    forms: list[str]

    def keys(self) -> np.ndarray:
        """Hashes of the grams that end at each word (words x 3)."""
        return _keys(self.form, self.place, self.forms)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys, none of which is negative, in order and once each."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def _members(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether keys are among some (see ``_distinct``); most that aren't are told by a few bits."""
    size = 1 << (16 * len(some)).bit_length()
    low = lambda x: (x ^ (x >> 17) ^ (x >> 31)) & (size - 1)
    may = np.zeros(size, bool)
    may[low(some)] = True
    out = may[low(keys)]
    own = keys[out]
    out[out] = some[np.searchsorted(some, own).clip(max=len(some) - 1)] == own
    return out


def opened(questions: list[str | None], answers: list[str]) -> tuple[list[Opened], Said]:
    """The features of the clauses of responses that their own text and their prompts show, and the clauses' words."""
    found = [clauses(a) for a in answers]
    flat = list(chain.from_iterable(found))
    words = [words_of(c) for c, _, _ in flat]
    table = Words()
    word, n = table.numbers(words)
    asking, q_n = table.numbers([words_of(q or "") for q in questions])
    table.close()
    rows, size, tongues = len(found), len(flat), len(_TONGUES)
    m = np.fromiter(map(len, found), np.int64, rows)
    end = np.cumsum(m)
    row, clause, q_row = np.repeat(np.arange(rows), m), np.repeat(np.arange(size), n), np.repeat(np.arange(rows), q_n)
    code, item = np.fromiter((x for _, x, _ in flat), bool, size), np.fromiter((x for _, _, x in flat), bool, size)
    full = np.fromiter((c[-1:] in ".!?" for c, _, _ in flat), bool, size)
    first, last = np.zeros(size, bool), np.zeros(size, bool)
    first[(end - m)[m > 0]] = last[end[m > 0] - 1] = True

    def votes(of: np.ndarray, tongue: np.ndarray, among: int) -> np.ndarray:
        some = tongue >= 0
        return np.bincount(of[some] * tongues + tongue[some], minlength=among * tongues).reshape(among, tongues)

    # Pairs of words of a clause that its prompt has too.
    low, q_low, kinds = table.low[word], table.low[asking], len(table) + 1
    near, q_near = np.flatnonzero(clause[1:] == clause[:-1]), np.flatnonzero(q_row[1:] == q_row[:-1])
    pair = (row[clause[near]] * kinds + low[near]) * kinds + low[near + 1]
    q_pair = _distinct((q_row[q_near] * kinds + q_low[q_near]) * kinds + q_low[q_near + 1])
    shared = _members(pair, q_pair)
    alone = np.flatnonzero(n[clause] == 1)
    echo = np.bincount(clause[near[shared]], minlength=size) / np.maximum(1, n - 1)
    echo[clause[alone]] = _members(row[clause[alone]] * kinds + low[alone], _distinct(q_row * kinds + q_low))
    covered = np.bincount(_distinct(pair[shared]) // kinds**2, minlength=rows) / np.maximum(1, np.bincount(q_pair // kinds**2, minlength=rows))

    asked = spoken(votes(q_row, table.tongue[asking], rows))
    others = votes(q_row, table.asked[asking], rows) > 0  # languages a prompt asks for by name
    said = votes(clause, table.tongue[word], size)
    said[code] = 0
    total = np.zeros((rows, tongues), np.int64)
    np.add.at(total, row, said)
    whole = spoken(total)[row]
    tongue = spoken(said)
    tongue = np.where((tongue < 0) & (whole >= 0) & (said[np.arange(size), whole] >= said.max(axis=1, initial=0)), whole, tongue)
    strange = ~code & (tongue >= 0) & (asked[row] >= 0) & (tongue != asked[row])

    sets = table.sets[word]
    some = np.flatnonzero(sets)
    marks = np.zeros(size, np.int64)
    np.bitwise_or.at(marks, clause[some], sets[some])
    person, negation, sorry, helping = (marks >> k & 1 > 0 for k in range(4))
    lead = (n > 0) & (n <= 4) & (np.bincount(clause[sets >> 4 & 1 > 0], minlength=size) == n)
    refusing = np.zeros(size, bool)
    for i in np.flatnonzero((person | negation | helping) & ~code).tolist():
        refusing[i] = refuses(flat[i][0])

    # Words by their forms; how often those that end a response occur, and end a sentence, in the rest of it.
    form, place = table.formed(word, n)
    written = ~code[clause]
    ends = full[clause]
    ends[near] = False
    stop = np.cumsum(n + 2)[end - 1] - 1 if size else np.zeros(rows, np.int64)  # the place of each response's last word
    ended = m > 0
    ended[ended] = n[end[ended] - 1] > 0
    own = np.zeros((rows, 6), np.int64)
    of = row[clause]
    same = np.flatnonzero(written & ended[of])
    for k in range(3):
        same = same[form[place[same] - k] == form[stop[of[same]] - k]]
        own[:, 2 * k] = np.bincount(of[same], minlength=rows)
        own[:, 2 * k + 1] = np.bincount(of[same[ends[same]]], minlength=rows)

    fence = np.fromiter(("```" in a and a.count("```") % 2 == 1 or "~~~" in a and a.count("~~~") % 2 == 1 for a in answers), bool, rows)
    closed, comma, tail = np.ones(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    facts = [0] * rows
    for r in np.flatnonzero(m > 0).tolist():
        i = int(end[r]) - 1
        text, is_code, is_item = flat[i]
        ws = words[i]
        done = text.rstrip("\"')]}>`*_ ")[-1:] in ".!?…:;" or text[-1:] == "`" or text[-1:].isalnum() and bool(_REFERENCE.search(text.rsplit(None, 1)[-1]))
        comma[i] = text[-1:] in ",([-–"
        tail[i] = bool(ws) and ws[-1].lower() in TAIL
        fact = WORDS * bool(ws) | CAPITAL * bool(ws and ws[-1][:1].isupper()) | UNKNOWN * bool(len(ws) > 1 and ws[-1].islower())
        if not done and not (m[r] == 1 and len(ws) <= 4):
            plain = not is_code and text[-1:] not in "`}>)]\"'"
            # Items of a list often have no full stop; one is cut off if the others have or if it ends in an unknown word.
            listed = is_item and not (m[r] > 1 and item[i - 1] and all(full[i + 1 - m[r] : i][item[i + 1 - m[r] : i]]))
            fact |= DANGLING * bool(comma[i] or tail[i] or is_code and fence[r]) | (LISTED if listed else PLAIN) * plain
        if is_code and fence[r] or m[r] > 1 and len(ws) <= 1 and _BARE.match(text):
            done = False
            fact |= DANGLING
        closed[i] = done
        facts[r] = fact

    bits = np.zeros((size, FEATURES), bool)
    columns = (
        True, first, last, m[row] == 1, person, negation, person & negation, sorry, sorry & first, helping, person & helping, negation & helping, refusing, refusing & first,
        False, echo >= 0.75, lead, strange, strange & ~others[row, tongue], tongue < 0, closed, comma, tail, code, code & fence[row] & last, item, last & ~closed, False, False, False, n <= 4,
    )
    for k, column in enumerate(columns):
        bits[:, k] = column
    echo, sizes = echo.astype(np.float32), np.maximum(1, n).astype(np.int32)
    cuts = zip((end - m).tolist(), end.tolist(), covered.tolist(), facts, own.tolist())
    return [Opened(bits[i:j], echo[i:j], sizes[i:j], share, fact, counts) for i, j, share, fact, counts in cuts], Said(form, place[written], ends[written], table.forms)


def describe(question: str | None, answer: str, ends: Ends) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Features of a response's clauses, their numbers of words, the tags that the rules give them, and the share of the prompt's word pairs that it repeats; sentence ends by ``ends``."""
    last_ = last_clause(answer)
    (o,), _ = opened([question], [answer])
    return o.closed(ends.counts(words_of(last_)) if last_ else [0] * 6, False)


def defect(tags: np.ndarray, sizes: np.ndarray, covered: float, leads: np.ndarray) -> str | None:
    """The defect of a response from its clauses' tags; covered: the share of the prompt's word pairs that it repeats."""
    total = sizes.sum()
    share = np.bincount(tags, sizes, 5) / total if total else np.zeros(5)
    if tags[-1:].tolist() == [UNFINISHED]:
        return "truncated_answer"
    if share[FOREIGN] >= 0.5:
        return "wrong_language"
    if tags[0] == REFUSAL and share[REFUSAL] >= 0.25 or share[REFUSAL] >= 0.5:
        return "refusal"
    rest = sizes[(tags != ECHO) & ~leads].sum()
    if share[ECHO] >= 0.5 and rest <= 2 and covered >= 0.6:
        return "copied_question"
    return None


class Tagger:
    def __init__(self) -> None:
        self.ends, self.chain = Ends(), Chain(FEATURES, 5)

    def learn(self, described: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> None:
        described = [d for d in described if len(d[0])]
        if described:
            rows = np.concatenate([[0], np.cumsum([len(d[0]) for d in described])])
            self.chain.fit(np.concatenate([d[0] for d in described]), rows, np.concatenate([d[2] for d in described]))

    def decide(self, described: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> list[str | None]:
        """The defects of described responses, each of which has a clause."""
        if not described:
            return []
        rows = np.concatenate([[0], np.cumsum([len(d[0]) for d in described])])
        tags = self.chain.best(np.concatenate([d[0] for d in described]), rows)
        return [defect(tags[rows[k] : rows[k + 1]], sizes, covered, x[:, 16] > 0) for k, (x, sizes, _, covered) in enumerate(described)]

    def fit(self, pairs: list[tuple[str | None, str | None]], tagged: int = TAGGED) -> None:
        """Learn from the pairs alone, sentence ends too."""
        real = [(q, a) for q, a in pairs if not is_nothing(a)]
        for _, a in real:
            for clause, code, _ in clauses(a):
                if not code:
                    self.ends.add(clause, prose.WORDS.findall(clause))
        self.learn([describe(q, a, self.ends) for q, a in real[:tagged]])

    def judge(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of every pair, or None, by the sentence ends learnt."""
        out: list[str | None] = ["empty_answer" if is_nothing(a) else None for _, a in pairs]
        keep = [(i, d) for i, d in ((i, describe(*pairs[i], self.ends)) for i, known in enumerate(out) if known is None) if len(d[0])]
        for (i, _), found in zip(keep, self.decide([d for _, d in keep])):
            out[i] = found
        return out


def _keys(form: np.ndarray, at: np.ndarray, forms: list[str]) -> np.ndarray:
    """Hashes of the grams that end at the places ``at`` of a text of forms' numbers (places x 3)."""
    value = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in forms], np.uint64)
    out = np.empty((len(at), 3), np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for n in range(3):
            total = W.mix64(total * np.uint64(3) + value[form[at - n]] + np.uint64(n + 1))
            out[:, n] = total
    return out


def last_grams(pairs: DataFrame) -> DataFrame:
    """(row, k0, k1, k2): the last grams of every response of (row, answer) that has a last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [(row, ws) for row, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not is_nothing(a) and (last_ := last_clause(a)) is not None and (ws := words_of(last_))]
            table = Words()
            word, n = table.numbers([ws[-4:] for _, ws in last])  # of four words three aren't the first
            table.close()
            form, place = table.formed(word, n)
            keys = _keys(form, place[np.cumsum(n) - 1], table.forms).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in last], pa.int64()), *(pa.array(np.ascontiguousarray(keys[:, n])) for n in range(3))], ["row", "k0", "k1", "k2"])

    return pairs.select("row", "answer").mapInArrow(run, "row long, k0 long, k1 long, k2 long")


def _slices(rows: list[int], questions: list[str | None], answers: list[str], most: int = 1 << 21) -> Iterator[list[int]]:
    """The rows in runs of about ``most`` characters; a longer text is in a run with few others."""
    own, size = [], 0
    for i in rows:
        own.append(i)
        size += len(answers[i]) + len(questions[i] or "")
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


READ = "row long, tbl string, id string, opened binary, key long, n long, last long"


def read(pairs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """One pass over (row, tbl, id, question, answer): what each pair's text shows (``opened``; null where the answer is nothing), and as rows without ``row`` how often grams whose bit is set occur (key, n, last) in the responses of a batch."""
    shared = pairs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            questions, answers = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            shown: list[bytes | None] = [None] * len(answers)
            flat, closing = [np.empty(0, np.uint64)], [np.empty(0, bool)]
            for own in _slices([i for i, a in enumerate(answers) if not is_nothing(a)], questions, answers):
                each, said = opened([questions[i] for i in own], [answers[i] for i in own])
                for i, o in zip(own, each):
                    shown[i] = o.packed()
                keys = said.keys().reshape(-1)
                some = set_in(bits, keys)
                flat.append(keys[some])
                closing.append(np.repeat(said.ends, 3)[some])
            key, index, n = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
            last = np.bincount(index, np.concatenate(closing), len(key)).astype(np.int64)
            m, k = batch.num_rows, len(key)
            none = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(x) for x in (
                    [batch.column(0), none(k, pa.int64())], [batch.column(1), none(k, pa.string())], [batch.column(2), none(k, pa.string())], [pa.array(shown, pa.binary()), none(k, pa.binary())],
                    [none(m, pa.int64()), pa.array(key.view(np.int64))], [none(m, pa.int64()), pa.array(n.astype(np.int64))], [none(m, pa.int64()), pa.array(last)],
                )],
                ["row", "tbl", "id", "opened", "key", "n", "last"],
            )

    return store(pairs.select("row", "tbl", "id", "question", "answer").mapInArrow(run, READ))


def counted(pairs: DataFrame) -> DataFrame:
    """(row, tbl, id, opened, counts) of pairs (row, tbl, id, question, answer): what they show, and of the last word, the last two and the last three of each response, how often they occur and end a sentence in all rows; null where it has no last word."""
    grams = store(last_grams(pairs))
    wanted = grams.select("row", F.posexplode(F.array("k0", "k1", "k2")).alias("at", "key"))
    seen = read(pairs, bitmap(wanted))
    sums = seen.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    each = wanted.join(sums, "key", "left").groupBy("row").agg(*(F.coalesce(F.max(F.when(F.col("at") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i in range(3) for c in ("n", "last")))
    counts = each.select("row", F.array(*(f"{c}{i}" for i in range(3) for c in ("n", "last"))).alias("counts"))
    return seen.filter("row is not null").select("row", "tbl", "id", "opened").join(counts, "row", "left")


def shuffled(rows: DataFrame, columns: list[str], sample: int) -> list[Row]:
    """A bounded sample in the order of the rows' hash, so that the first ones are a sample of all tables too."""
    return sorted(bounded(rows, columns, sample, "opened" if "opened" in rows.columns else None), key=lambda r: r["row"])


def _described(data: list[bytes | None], counts: list[list[int] | None]) -> list[tuple[int, tuple]]:
    """(place, description) of those that have clauses."""
    found = [(i, Opened.unpacked(x).closed(c or [0] * 6)) for i, (x, c) in enumerate(zip(data, counts)) if x is not None]
    return [(i, d) for i, d in found if len(d[0])]


def judged(pairs: DataFrame, sample: int = TAGGED) -> DataFrame:
    """(tbl, id, defect) of every defective pair of (tbl, id, question, answer)."""
    columns = ["tbl", "id", "question", "answer"]
    one = store(pairs.select(*columns).distinct().withColumn("row", F.xxhash64(*columns)))
    rows = store(counted(one))
    drawn = shuffled(rows.filter("opened is not null"), ["row"], sample)
    tagger = Tagger()
    tagger.learn([d for _, d in _described([r["opened"] for r in drawn], [r["counts"] for r in drawn])])
    shared = pairs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data = part.column(2).to_pylist()
                keep = _described(data, part.column(3).to_pylist())
                found = ["empty_answer" if x is None else None for x in data]
                for (i, _), why in zip(keep, shared.value.decide([d for _, d in keep])):
                    found[i] = why
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["tbl", "id", "defect"])
                yield out.filter(pa.array([d is not None for d in found], pa.bool_()))

    return rows.select("tbl", "id", "opened", "counts").mapInArrow(run, "tbl string, id string, defect string").distinct()
