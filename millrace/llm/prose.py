"""Running prose of documents: sentences without fields, code, logs, tables and headings, and their language.

Word lists below are fixed values: common words that tell four languages apart.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

COMMON = {
    "en": "the of and to in is it was that for on are with as be at by this have from or an not but they which one had you were all there would been their we when who will more no if out so what up them about into than can only other some could two then do any like now over such our even most made after did many before must through where much your way well should because each just those how too little good very make still own see work long get here between both being under never same another know while might us off go come since against right came take used himself few house use during without again place around however found put every has my your i he she hence therefore".split(),
    "de": "der die das und ist nicht ein eine einer einem einen den dem des zu mit von auf für im am als auch es an werden wird aus er sie hat dass nach bei um noch wie nur oder aber vor zur bis mehr durch man sein wurde sind haben kann wenn so ich wir ihr uns über zum ohne nachts gestern bitte danach zuerst sobald falls laut zwischen".split(),
    "fr": "le la les des du un une et est dans pour que qui au aux par sur ne pas plus ce cette avec il elle ils nous vous son sa ses leur se ou mais sont été être fait a à en sans encore après avant selon chaque peut doit puis parce lorsque depuis entre comme tout on y ont avons".split(),
    "es": "el la los las de del y en que es un una por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos puede tiene debe falta hemos".split(),
}
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_FENCE = re.compile(r"^\s*(```|~~~)")
_LOG = re.compile(r"^\s*(\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\[?(DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b)")
_TABLE = re.compile(r"^\s*\||\|\s*$|^\s*[-=+|:\s]{4,}$|\t.*\t")
_FIELD = re.compile(r"^\s*[A-Z][\w /-]{0,24}:(\s|$)")
_ENTRY = re.compile(r"^\s*(Debit|Credit|Balance|Total|Memo|Price|Cost|Tags?|Account|Amount|SKU|Ref)\b.*\d")
_CODE = re.compile(r"^(\s{4,}|\t)\S|^\s*(def |class |return\b|import |from \w+ import|if .*:$|for .*:$|while .*:$|else:|try:|except|#\s|//|\{|\}|</?\w+)|[;{}]\s*$|^\s*\w+(\.\w+)*\s*(=|\+=|\()\s*\S+.*[)\]]?$|^\s*[\w.]+\(.*\)\s*$")
_HEAD = re.compile(r"^\s*#{1,6}\s")
_MARK = re.compile(r"^\s*([-*•]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
#: A line without any of these is prose, whatever else it holds; only others are looked at closely.
_DOUBT = re.compile(r"^[^A-Za-z\"'“‘(¿¡]|^[\w /-]{1,25}:|^(?:Debit|Credit|Balance|Total|Memo|Price|Cost|Tags?|Account|Amount|SKU|Ref)\b|^(?:def|class|return|import|from|if|for|while|else|try|except)\b|[|={};`\t]|[(\[].*[)\]]$|_\w+\(|^[\w.]+\(")


def prose_lines(text: str) -> list[str]:
    """Lines of a text that may be running prose; others are empty."""
    out: list[str] = []
    fenced = False
    doubt = _DOUBT.search
    for line in text.splitlines():
        if not fenced and line and not doubt(line):
            out.append(line)
        elif _FENCE.match(line):
            fenced = not fenced
            out.append("")
        elif fenced or not line.strip() or _LOG.match(line) or _TABLE.search(line) or _HEAD.match(line) or _FIELD.match(line) or _ENTRY.match(line) or _CODE.search(line):
            out.append("")
        else:
            out.append(_MARK.sub("", line))
    return out


def sentences(text: str) -> list[str]:
    """Sentences of the running prose; wrapped lines are joined, short lone lines dropped as headings.

    A line goes on in the next if it doesn't end a sentence and the next begins
    with a small letter or digit, or if it is as long as wrapped text.
    """
    out: list[str] = []
    paragraph: list[str] = []
    for line in [*prose_lines(text), ""]:
        if line:
            if paragraph and paragraph[-1][-1:] not in ".!?…" and (line[0].islower() or line[0].isdigit() or len(paragraph[-1]) >= 60):
                paragraph[-1] = f"{paragraph[-1].rstrip()} {line}".rstrip()
            else:
                paragraph.append(line.rstrip())
            continue
        for part in paragraph:
            if len(paragraph) == 1 and len(part) < 90 and part[-1:] not in '.!?…"' and part.count(" ") < 9:
                continue
            out += _SENTENCE.split(part) if ". " in part or "! " in part or "? " in part else [part]
        paragraph = []
    return [s for s in out if s]


class Languages:
    """Languages of many hashed words at once."""

    def __init__(self) -> None:
        from . import words as W

        names = sorted(COMMON)
        self.names, self.bits = names, 14
        self.hash, self.code = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int8)
        seen: dict[int, set[int]] = {}
        for code, name in enumerate(names):
            hashes, _ = W.words(pa.array(COMMON[name]))
            for h in hashes.tolist():
                seen.setdefault(h, set()).add(code)
        for h, codes in seen.items():
            if len(codes) == 1:  # a word of several languages tells nothing
                at = h & ((1 << self.bits) - 1)
                self.hash[at], self.code[at] = h, next(iter(codes))

    def counts(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Common words of each language in every row: rows x languages, in the order of ``names``."""
        at = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        code = np.where(self.hash[at] == hashes, self.code[at], -1)
        out = np.zeros((len(rows) - 1, len(self.names)), np.int64)
        for c in range(len(self.names)):
            total = np.concatenate([[0], np.cumsum(code == c)])
            out[:, c] = total[rows[1:]] - total[rows[:-1]]
        return out
