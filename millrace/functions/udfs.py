"""What no built-in expression can do, as Arrow-batched functions; nulls give null unless stated."""

from __future__ import annotations

import ast
import difflib
import json
import math
import operator
import re
import unicodedata
import warnings
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

_SILENT = frozenset({"script", "style", "noscript", "template", "svg"})


class _Reader(HTMLParser):
    """Collects text nodes, the title and links of a document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.titled, self.title, self.text, self.links = 0, False, "", [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.depth += 1
        self.titled = self.titled or tag == "title"
        if tag == "a" and (target := dict(attrs).get("href")):
            self.links.append(target)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.depth:
            self.depth -= 1
        if tag == "title":
            self.titled = False

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.titled:
            self.title += data
        elif piece and not self.depth:
            self.text.append(piece)


def read_html(html: str) -> tuple[str, str, list[str]]:
    """Text (a line per text node), title and link targets of a document."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(reader.text), reader.title.strip(), reader.links


def followed(links: list[str], base: str) -> list[str]:
    """Distinct links to the same host, absolute and without fragment, in order."""
    own, out = urlsplit(base).netloc, {}
    for link in links:
        if link.startswith(("#", "mailto:", "javascript:")):
            continue
        whole = urljoin(base, link).split("#")[0]
        if urlsplit(whole).netloc == own:
            out[whole] = None
    return list(out)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("title", StringType())]))
def html_text(html: pd.Series) -> pd.DataFrame:
    """Visible text and title of an HTML document."""
    rows = [(None, None) if h is None else read_html(h)[:2] for h in html]
    return pd.DataFrame(rows, columns=["text", "title"])


@F.pandas_udf(ArrayType(StringType()))
def html_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Links of an HTML document to its own host."""
    return pd.Series([None if h is None or b is None else followed(read_html(h)[2], b) for h, b in zip(html, base)])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


_RUNS, _BINS = (3, 4), 8192  # letters of a run, and numbers by which runs are counted


def _run_counts(text: str) -> tuple[np.ndarray, ...]:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for size in _RUNS:
        total = np.zeros(max(0, len(code) - size + 1), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(size):
                total = (total ^ code[k : k + len(total)]) * np.uint32(0x9E3779B1)
        out.append(np.bincount(total >> np.uint32(19), minlength=_BINS).astype(np.int32))
    return tuple(out)


@F.pandas_udf(DoubleType())
def sequence_ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``sequence_ratio`` where it may reach ``least``; null where the runs of three and of four letters that both texts have rule it out.

    Texts of m + n letters that match to the ratio r have r (m + n) / 2 letters
    in matching blocks, and no more blocks than (1 - r) (m + n) unmatched
    letters can part, and one; a block shares all its runs of q letters but q - 1.
    """
    counts: dict[str, tuple[np.ndarray, ...]] = {}
    matcher, last, out = difflib.SequenceMatcher(None), None, []

    def runs(t: str) -> tuple[np.ndarray, ...]:
        if t not in counts:
            if len(counts) > 1000:
                counts.clear()
            counts[t] = _run_counts(t)
        return counts[t]

    for x, y, low in zip(a, b, least):
        if x is not None and y is not None:
            size = len(x) + len(y)
            needed = [low * size / 2 - (q - 1) * ((1 - low) * size + 1) - 1e-9 for q in _RUNS]
            if all(n <= 0 or np.minimum(p, q).sum() >= n for n, p, q in zip(needed, runs(x), runs(y))):
                if y != last:
                    matcher.set_seq2(y)
                    last = y
                matcher.set_seq1(x)
                out.append(matcher.ratio())
                continue
        out.append(None)
    return pd.Series(out, dtype=float)


# So that a condition on the ratio isn't evaluated apart from the ratio itself.
sequence_ratio_from = sequence_ratio_from.asNondeterministic()


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
LONGEST, DEEPEST, POWER, LARGEST = 200, 32, 12, 10**100  # fixed values: characters, nesting, exponent, value


def _sound(x: float) -> float:
    if not (math.isfinite(x) if isinstance(x, float) else abs(x) <= LARGEST):
        raise ValueError("too large")
    return x


def evaluated(expression: str) -> float | None:
    """Value of an arithmetic expression of numbers; None for anything else, and beyond the bounds of length, nesting, powers and values."""

    def value(node: ast.AST, depth: int) -> float:
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        match node:
            case ast.Constant(value=x) if type(x) in (int, float):
                return _sound(x)
            case ast.UnaryOp(op=sign, operand=x) if type(sign) in _OPERATORS:
                return _OPERATORS[type(sign)](value(x, depth + 1))
            case ast.BinOp(left=x, op=sign, right=y) if type(sign) in _OPERATORS:
                x, y = value(x, depth + 1), value(y, depth + 1)
                if isinstance(sign, ast.Pow) and abs(y) > POWER:
                    raise ValueError("power too large")
                return _sound(_OPERATORS[type(sign)](x, y))
        raise ValueError("not arithmetic")

    try:
        return float(value(ast.parse(expression.strip(), mode="eval").body, 1)) if 0 < len(expression) <= LONGEST else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, TypeError, MemoryError):
        return None


@F.pandas_udf(DoubleType())
def calculated(expression: pd.Series) -> pd.Series:
    """Value of an arithmetic expression; null if it isn't one."""
    return pd.Series([None if e is None else evaluated(e) for e in expression])


def code_facts(text: str) -> tuple[str | None, list[str]]:
    """The first block of a text that is Python with an import, function or class, and the roots of its imports."""
    for block in re.findall(r"```(?:python|py)?\s*\n(.*?)```", text, re.S) or [text]:
        try:
            nodes = list(ast.walk(ast.parse(block)))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        if any(isinstance(n, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) for n in nodes):
            roots = {a.name.split(".")[0] for n in nodes if isinstance(n, ast.Import) for a in n.names} | {n.module.split(".")[0] for n in nodes if isinstance(n, ast.ImportFrom) and n.module and not n.level}
            return block, sorted(roots)
    return None, []


@F.pandas_udf(StructType([StructField("code", StringType()), StructField("imports", ArrayType(StringType()))]))
def python_code(text: pd.Series) -> pd.DataFrame:
    """Python code in a text and what it imports."""
    return pd.DataFrame([(None, []) if t is None else code_facts(t) for t in text], columns=["code", "imports"])


#: Calls and modules that code isn't to be run with.
UNSAFE_CALLS = frozenset("eval exec compile __import__ system popen remove rmdir unlink removedirs rmtree chmod chown kill fork setuid".split())
UNSAFE_MODULES = frozenset("socket shutil subprocess ctypes urllib http ftplib smtplib multiprocessing pty signal".split())


def refusal(code: str) -> str:
    """Why code isn't to be run: the first unsafe call or import, breadth first; empty if there is none or it can't be parsed."""

    def why(node: ast.AST) -> str | None:
        match node:
            case ast.Call(func=ast.Name(id=name)) if name in UNSAFE_CALLS:
                return f"calls {name}()"
            case ast.Call(func=ast.Attribute(attr=name)) if name in UNSAFE_CALLS:
                return f"calls .{name}()"
            case ast.Import(names=names):
                return next((f"imports {n.name}" for n in names if n.name.partition(".")[0] in UNSAFE_MODULES), None)
            case ast.ImportFrom(module=str(name)) if name.partition(".")[0] in UNSAFE_MODULES:
                return f"imports {name}"
        return None

    try:
        return next(filter(None, map(why, ast.walk(ast.parse(code)))), "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ""


@F.pandas_udf(StructType([StructField("code", StringType()), StructField("imports", ArrayType(StringType())), StructField("refusal", StringType())]))
def code_report(text: pd.Series) -> pd.DataFrame:
    """Python code in a text, what it imports, and why it isn't to be run."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of invalid escapes in the code looked at
        found = [(None, []) if t is None else code_facts(t) for t in text]
        return pd.DataFrame([(c, i, refusal(c) if c else "") for c, i in found], columns=["code", "imports", "refusal"])


def first_json(text: str) -> str | None:
    """The first JSON object or array in a text, as canonical JSON."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def embedded_json(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else first_json(t) for t in text])


@F.pandas_udf(StringType())
def leading_json(text: pd.Series) -> pd.Series:
    """The JSON value that begins at the first bracket of a text, as canonical JSON; null if none begins there."""

    def at(t: str) -> str | None:
        m = re.search(r"[{\[]", t)
        try:
            return json.dumps(json.JSONDecoder().raw_decode(t, m.start())[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if m else None
        except (ValueError, RecursionError):
            return None

    return pd.Series([None if t is None else at(t) for t in text])


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, indented by two; what can't be parsed stays as it is."""

    def pretty(t: str) -> str:
        try:
            return json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False)
        except (ValueError, RecursionError):
            return t

    return pd.Series([None if t is None else pretty(t) for t in text])


FUNCTIONS = {"html_text": html_text, "html_links": html_links, "nfkc": nfkc, "sequence_ratio": sequence_ratio, "calculated": calculated, "python_code": python_code, "embedded_json": embedded_json, "leading_json": leading_json, "pretty_json": pretty_json, "code_report": code_report}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("chunk_text", chunk_table())


def chunk_table():
    """A table function: chunk_text(text) gives (ordinal, chunk)."""
    from pyspark.sql.functions import udtf

    from ..operators.retrieval import chunks

    @udtf(returnType="ordinal: int, chunk: string")
    class ChunkText:
        def eval(self, text: str):
            yield from enumerate(chunks(text))

    return ChunkText
