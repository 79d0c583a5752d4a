"""Text functions as column expressions; none leaves the JVM.

Every function gives null for null unless its docstring says otherwise.
White space is what Python's ``\\s`` matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once though ``of`` uses it in an inner function; null for null."""
    return F.when(value.isNotNull(), F.element_at(F.transform(F.array(value), of), 1))


SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def normalized(c: Column | str) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), f"{SPACE}+", " "))


def text_hash(c: Column | str) -> Column:
    """SHA-256 of the normalized text."""
    return F.sha2(normalized(c), 256)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4).cast("int")))


def is_blank(c: Column | str) -> Column:
    """Whether a text is null, empty or white space only; never null."""
    return F.coalesce(stripped(c) == "", F.lit(True))


def occurrences(c: Column | str, part: str) -> Column:
    """How often a part occurs in a text, without overlap."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(part)))) / len(part)).cast("int")


def contains_any(c: Column | str, parts: tuple[str, ...]) -> Column:
    """Whether a text has one of the parts; parts are matched as they are, not as words."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(col(c), F.lit(part))
    return out


def without_tags(c: Column | str) -> Column:
    """Markup tags cut out."""
    return F.regexp_replace(col(c), "<[^>]+>", "")


def masked_emails(c: Column | str, mask: str = "[email]") -> Column:
    return F.when(F.contains(col(c), F.lit("@")), F.regexp_replace(col(c), r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b", mask)).otherwise(col(c))


def runs(words: Column, size: int, whole: Column | None = None) -> Column:
    """Distinct runs of ``size`` neighbouring words, joined by blanks; fewer words make one run (or ``whole``, if given); no word, none."""

    def of(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        few = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= size, F.array_distinct(some)).otherwise(few if whole is None else F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))

    return bound(words, of)


def word_shingles(c: Column | str, size: int = 5, pattern: str = "[a-z0-9]+") -> Column:
    """Distinct runs of ``size`` words of the normalized text; fewer words make one shingle; no word, none."""
    return runs(F.regexp_extract_all(normalized(c), F.lit(f"({pattern})")), size)


def word_runs(c: Column | str, size: int = 5) -> Column:
    """Distinct runs of ``size`` words (letters, digits and underscores of any script) of a text as it is; one of fewer words is its own run."""
    return runs(F.regexp_extract_all(col(c), F.lit(r"((?U)\w+)")), size, col(c))


def space_shingles(c: Column | str, size: int = 6) -> Column:
    """Distinct runs of ``size`` parts of the normalized text between blanks."""
    return runs(F.filter(F.split(normalized(c), " "), lambda w: w != ""), size)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common elements of two arrays; 0 if either is empty."""
    x, y = col(a), col(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def containment(a: Column | str, b: Column | str) -> Column:
    """Share of the first array's elements that the second has; 0 if either is empty."""
    x, y = col(a), col(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


# Fixed values of the tokenizer: stop words and suffixes in order.
STOP_WORDS = tuple("""
a an and are as at be but by for from has have he her his i if in into is it its of on or that the their then there these they
this to was were will with you your our not no do does did can could should would may might must shall about after all also am
because been before being between both down each few further here him himself how more most other over same so some such than
too very when where which while who whom why
""".split())
SUFFIXES = ("ational", "iveness", "fulness", "ousness", "ization", "ation", "ings", "ies", "ing", "ers", "est", "ed", "es", "s")


def stem(word: Column) -> Column:
    """The word without the first suffix that applies and leaves three letters."""
    n, out = F.length(word), word
    for suffix in reversed(SUFFIXES):
        applies = F.endswith(word, F.lit(suffix)) & (n - len(suffix) >= 3)
        if suffix == "s":
            applies = applies & ~word.rlike("(us|ss|is)$")
        elif suffix == "es":
            applies = applies & word.rlike("(s|x|z|ch|sh)es$")
        base = F.substring(word, F.lit(1), n - len(suffix))
        out = F.when(applies, F.concat(base, F.lit("y")) if suffix == "ies" else base).otherwise(out)
    return F.when(n <= 3, word).otherwise(out)


def identifier_parts(token: Column) -> Column:
    """Parts of snake_case, camelCase, HTTPResponse and dotted.paths."""
    marked = F.regexp_replace(F.regexp_replace(token, "(?<=[a-z0-9])(?=[A-Z])", "."), "(?<=[A-Z])(?=[A-Z][a-z])", ".")
    return F.filter(F.split(marked, r"[._]+"), lambda p: p != "")


def raw_tokens(c: Column | str) -> Column:
    """Words of a text as the tokenizer sees them; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("([A-Za-z0-9][A-Za-z0-9_+#.-]*)"))


def terms_of(token: Column) -> Column:
    """Index terms of one word: its stem, if it has 2 to 40 letters and is no stop word, then the stems of its parts."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    whole = F.lower(token)
    own = F.when((F.length(whole) >= 2) & (F.length(whole) <= 40) & ~whole.isin(*STOP_WORDS), F.array(stem(whole))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.transform(identifier_parts(token), F.lower), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w) & (w != whole))
    # Only words with a joint or a large letter within have parts of their own.
    return F.when(token.rlike("[._]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), F.concat(own, F.transform(parts, stem))).otherwise(own)


def terms(c: Column | str) -> Column:
    """Index terms of a text, repeated as they occur; an empty array for null. For long texts explode ``raw_tokens`` and use ``terms_of``."""
    return F.flatten(F.transform(raw_tokens(c), terms_of))


def unique_terms(c: Column | str) -> Column:
    return F.array_distinct(terms(c))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of a text as it is."""
    return F.sha2(col(c), 256)
