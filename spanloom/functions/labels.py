"""Label maps, routing and rounding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names and their legacy aliases.
SPAN_LABELS = ("IT_TERM", "CLERICAL_TERM")
DICTIONARY_LABELS = ("IT_TASK", "CLERICAL")
TO_SPAN_LABEL = {"IT_TASK": "IT_TERM", "CLERICAL": "CLERICAL_TERM", "IT_TERM": "IT_TERM", "CLERICAL_TERM": "CLERICAL_TERM"}
TO_DICTIONARY_LABEL = {"IT_TERM": "IT_TASK", "CLERICAL_TERM": "CLERICAL", "IT_TASK": "IT_TASK", "CLERICAL": "CLERICAL"}
ACCEPTED, NEEDS_REVIEW = "ACCEPTED", "NEEDS_REVIEW"
ACCEPT_FROM = 0.80
FALLBACK_CONFIDENCE = 0.85


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapping(names: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in names.items() for v in kv])


def to_label(x: Column | str, names: Mapping[str, str] = TO_SPAN_LABEL, strict: bool = False) -> Column:
    """The label's name after trimming and upper-casing; unknown labels are null, or fail if strict."""
    found = F.try_element_at(mapping(names), F.upper(F.trim(_c(x))))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown label: "), _c(x)))) if strict else found


def lenient_label(x: Column | str, names: Mapping[str, str] = TO_SPAN_LABEL) -> Column:
    """Known labels mapped as they are written, others unchanged."""
    return F.coalesce(F.try_element_at(mapping(names), _c(x)), _c(x))


def is_label(x: Column | str, labels: tuple[str, ...] = SPAN_LABELS) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))).isin(*labels), F.lit(False))


def infer_label(raw: Column | str, surface: Column | str, second_words: tuple[str, ...], labels: tuple[str, str] = SPAN_LABELS, marks: tuple[str, str] = ("IT", "CLERICAL")) -> Column:
    """A label from loose text: the first mark it contains decides, else whether the surface holds one of second_words.

    A raw label such as ENTITY contains the first mark and therefore counts as the first label.
    """
    upper, low = F.upper(F.coalesce(_c(raw), F.lit(""))), F.lower(_c(surface))
    by_word = F.lit(False)
    for w in second_words:
        by_word = by_word | F.contains(low, F.lit(w))
    return F.when(F.contains(upper, F.lit(marks[0])), labels[0]).when(F.contains(upper, F.lit(marks[1])), labels[1]).when(by_word, labels[1]).otherwise(labels[0])


def route(confidence: Column | str, accept_from: float = ACCEPT_FROM) -> Column:
    return F.when(_c(confidence) >= accept_from, ACCEPTED).otherwise(NEEDS_REVIEW)


def clamp_confidence(p: Column | str, fallback: float = FALLBACK_CONFIDENCE) -> Column:
    """At most 0.9999, four decimals; the fallback where p is null or not positive."""
    return F.when(_c(p) > 0, F.round(F.least(F.lit(0.9999), _c(p)), 4)).otherwise(F.lit(fallback))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), F.lit(0.0))


def percentage(part: Column | str, whole: Column | str, digits: int) -> Column:
    return F.round(100 * ratio(part, whole), digits)


def signed(x: Column | str) -> Column:
    """A lift for reports: always a plus sign, then the number and a percent sign; see report.lift."""
    return F.concat(F.lit("+"), F.round(_c(x), 2).cast("string"), F.lit("%"))


def class_of(labels: Column | str, first: str = SPAN_LABELS[0]) -> Column:
    """negative, both, it_only or cl_only for an array of span labels; labels other than the first count as the second."""
    x = F.coalesce(_c(labels), F.array().cast("array<string>"))
    has_first, has_other = F.array_contains(x, first), F.exists(x, lambda y: y != first)
    return F.when(F.size(x) == 0, "negative").when(has_first & F.array_contains(x, SPAN_LABELS[1]), "both").when(has_first, "it_only").when(has_other, "cl_only").otherwise("cl_only")
