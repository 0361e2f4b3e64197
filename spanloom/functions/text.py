"""String normalisation, tokens, sentences and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing understands it (the pattern works in Java and in RE2).
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a string.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space that is not a single space already; the look ahead spares most characters the long class.
_WIDE = rf"(?=[\x00-\x20\x{{85}}-\x{{3000}}])(?:(?! ){SPACE}{SPACE}*| {SPACE}+)"
#: Lossless tokens: word runs, runs of plain white space, single other characters.
TOKEN = r"[\p{L}\p{N}_]+|[ \t\n\r\f]+|[^\p{L}\p{N}_ \t\n\r\f]"
WORD_RUN = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """White space removed from both ends; null stays null."""
    return F.btrim(_c(x), F.lit(SPACES))


def lower_strip(x: Column | str) -> Column:
    return F.lower(strip(x))


def collapse(x: Column | str) -> Column:
    """Stripped, inner white space as single spaces, case kept."""
    return F.regexp_replace(strip(x), _WIDE, " ")


def normalise(x: Column | str) -> Column:
    """Lower case, stripped, inner white space as single spaces."""
    return F.lower(collapse(x))


def source_id(x: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalise(x).cast("binary"), 256), 1, 16)


def is_blank(x: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(x) == "", F.lit(True))


def span_slice(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """text[start:end] in code points."""
    return F.substring(_c(text), _c(start) + 1, F.greatest(_c(end) - _c(start), F.lit(0)))


def snippet(x: Column | str, limit: int = 80, always: bool = False) -> Column:
    """The first limit characters, with three dots if more follow (or always, line breaks as spaces)."""
    x = _c(x)
    if always:
        return F.concat(F.regexp_replace(F.left(x, F.lit(limit)), "\n", " "), F.lit("..."))
    return F.concat(F.left(x, F.lit(limit)), F.when(F.length(x) > limit, "...").otherwise(""))


def tokens(x: Column | str) -> Column:
    """All characters of a text as lossless tokens."""
    return F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(0))


def words(x: Column | str) -> Column:
    """Lower-cased tokens that aren't white space."""
    return F.filter(F.transform(tokens(x), F.lower), lambda t: ~t.rlike(f"^{SPACE}+$"))


def word_set(x: Column | str) -> Column:
    """Distinct word runs in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(WORD_RUN), F.lit(0)))


def char_word_counts(x: Column | str) -> tuple[Column, Column]:
    """Characters and white-space separated words."""
    return F.length(_c(x)), F.size(F.filter(F.split(_c(x), f"{SPACE}+"), lambda w: w != ""))


def sentences(x: Column | str) -> Column:
    """Trimmed, non-empty sentences: text is cut after ., ! or ? before white space."""
    return F.filter(F.transform(F.split(_c(x), rf"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")


def ngrams(toks: Column | str, n: int) -> Column:
    """Distinct n-grams of a token array, joined by a space; none if it is shorter."""


    def grams(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(_c(toks)), grams)[0]  # the tokens are bound, so that they are made once


def term_pattern(term: str) -> str:
    """A Java pattern for a term in any case; an end that is a word character must not touch another one."""
    import re

    def edge(c: str) -> bool:
        return c.isalnum() or c == "_"

    body = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    return "(?iu)" + (r"(?<![\p{L}\p{N}_])" if term and edge(term[0]) else "") + body + (r"(?![\p{L}\p{N}_])" if term and edge(term[-1]) else "")
