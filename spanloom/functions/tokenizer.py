"""A rule tokenizer as one expression: prefixes, suffixes, infixes and exceptions, compiled to one pattern.

At each place the first rule that fits gives a token: white space, addresses (URL, mail), exceptions (abbreviations, contractions cut in parts),
initials, numbers (apart from a unit behind them), the endings of contractions, words, runs of dots or dashes, and else a single
character. Tokens are lossless: joined, they are the text. Nothing repeats a group that could recurse, so length is no limit.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that keep their dot, words in several tokens, endings of contractions, units behind numbers.
ABBREVIATIONS = (
    "a.k.a.", "a.m.", "p.m.", "approx.", "Ave.", "Bros.", "ca.", "cf.", "Co.", "Corp.", "Dept.", "Dr.", "e.g.", "ed.", "eds.", "Est.", "et al.", "etc.", "fig.", "Fig.", "Gen.", "Gov.", "i.e.", "Inc.", "Jr.",
    "Ltd.", "Mr.", "Mrs.", "Ms.", "Mt.", "No.", "Nos.", "op. cit.", "Ph.D.", "pp.", "Prof.", "Rep.", "Rev.", "Sen.", "Sr.", "St.", "viz.", "vol.", "Vol.", "vs.",
)
PARTS = {"cannot": ("can", "not"), "gonna": ("gon", "na"), "gotta": ("got", "ta"), "wanna": ("wan", "na"), "lemme": ("lem", "me"), "gimme": ("gim", "me"), "o'clock": ("o'clock",), "ma'am": ("ma'am",), "y'all": ("y'", "all"), "'tis": ("'t", "is"), "'twas": ("'t", "was")}
ENDINGS = ("s", "m", "d", "re", "ve", "ll", "em")
UNITS = ("mm", "cm", "km", "m", "mg", "kg", "g", "ml", "l", "ms", "s", "min", "h", "Hz", "kHz", "MHz", "GHz", "B", "KB", "MB", "GB", "TB", "am", "pm", "px")


@dataclass(frozen=True)
class Rules:
    abbreviations: Sequence[str] = ABBREVIATIONS
    parts: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(PARTS))
    endings: Sequence[str] = ENDINGS
    units: Sequence[str] = UNITS

    def __post_init__(self) -> None:
        wrong = [w for w, p in self.parts.items() if "".join(p) != w or not all(p)]
        if wrong or "" in (*self.abbreviations, *self.endings, *self.units):
            raise ValueError(f"the parts of a word must make it up, and nothing may be empty: {wrong}")


W = r"[\p{L}\p{M}\p{N}_]"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def literal(s: str) -> str:
    """A pattern for s, with straight or curly apostrophes."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", s).replace("'", "['’]")


def any_of(words: Sequence[str]) -> str:
    return "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def pattern(rules: Rules = Rules()) -> str:
    """The rules as a Java pattern."""
    cut = []
    for word, own in sorted(rules.parts.items(), key=lambda x: (-len(x[0]), x[0])):
        for k, part in enumerate(own):
            before, after = literal("".join(own[:k])), literal("".join(own[k + 1 :]))
            cut.append(rf"(?i:(?<=(?<!{W}){before}){literal(part)}(?={after}(?!{W})))" if k else rf"(?i:(?<!{W}){literal(part)}(?={after}(?!{W})))")
    none = rf"n['’]t(?!{W})"
    steps = [
        rf"{SPACE}++",
        r"(?:(?i:https?|ftp)://|(?i:www)\.)[^\s<>\"“”]*[^\s<>\"“”.,;:!?'’)\]}]",
        rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}_%+-][\p{{L}}\p{{N}}._%+-]{{0,63}}+@[\p{{L}}\p{{N}}-]{{1,63}}+(?:\.[\p{{L}}\p{{N}}-]{{2,63}}+){{1,8}}+",
        *([rf"(?<!{W})(?:{any_of(rules.abbreviations)})(?!{W})"] if rules.abbreviations else []),
        *cut,
        rf"(?<!{W})(?:\p{{L}}\.){{2,}}+(?!{W})",
        rf"(?<!{W})\p{{N}}++(?:[.,:]\p{{N}}++)*+(?=(?:{any_of(rules.units)})(?!{W})|(?!{W}))" if rules.units else rf"(?<!{W})\p{{N}}++(?:[.,:]\p{{N}}++)*+(?!{W})",
        rf"(?<={W})(?i:{none})",
        *([rf"(?<={W})['’](?i:{any_of(rules.endings)})(?!{W})"] if rules.endings else []),
        rf"(?i:[\p{{L}}\p{{M}}]{{1,40}}?(?={none}))",
        rf"{W}++",
        r"\.{2,}+|-{2,}+",
        r"(?s:.)",
    ]
    return "|".join(steps)


def rule_tokens(text: Column | str, rules: Rules = Rules()) -> Column:
    """The tokens of a text, white space included; null of a null text."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern(rules)), F.lit(0))
