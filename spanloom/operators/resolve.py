"""Conflicts between model and dictionary spans, merging, trimming, extraction."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.config import LEADING_TRIM, TRAILING_TRIM, TRIM_MARKS
from ..functions.text import is_blank, lower_strip, span_slice, strip
from .dictionary import dictionary_entities, small
from .names import unused
from .overlaps import overlap_join
from .scratch import Scratch

ENTITY = ["start", "end", "term", "category", "confidence", "source", "status"]
MODES = ("hybrid", "transformer_only", "entity_ruler_only")


def trimmed(term: str, leading: frozenset[str], trailing: frozenset[str]) -> tuple[int, str]:
    """Where the kept part of a span's text begins, and the kept part ("" if nothing is kept); see trim_spans."""
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", term)]
    bare = [term[i:j].lower().strip(TRIM_MARKS) for i, j in at]
    first, last = 0, len(at) - 1
    while first < last and bare[first] in leading:
        first += 1
    while first < last and bare[last] in trailing:
        last -= 1
    if not at:
        return 0, ""
    kept = term[at[first][0] : at[last][1]]
    lone = first == last and (bare[first] in leading or bare[first] in trailing) and kept != kept.upper()
    return (0, "") if lone else (at[first][0], kept)


def trim_spans(spans: DataFrame, known: DataFrame | None = None, key: str = "doc_id", leading: Sequence[str] = LEADING_TRIM, trailing: Sequence[str] = TRAILING_TRIM) -> DataFrame:
    """Spans without white space and listed words at their ends; needs term, the slice of the text.

    Words are runs without white space, compared in lower case without the marks at their ends. At each step the first word goes if it is listed
    as leading, else the last if it is listed as trailing; the last remaining word goes too, and the span with it,
    unless it is in capitals. A span whose term is known (a table term, lower case) keeps its offsets.

    The steps end at the first word that isn't leading, or, before that, take words from the end only when no leading word
    is left; so the leading run is taken first, then the trailing run, both at most up to the last word.
    """
    lead, trail = frozenset(leading), frozenset(trailing)

    @F.pandas_udf("at int, kept string")
    def cut(terms: pd.Series) -> pd.DataFrame:
        own = {t: trimmed(t or "", lead, trail) for t in terms.unique()}
        return pd.DataFrame([own[t] for t in terms], columns=["at", "kept"])

    mark, part = unused(spans, "_known", "_cut")
    if known is not None:
        names = small(known.select(F.col("term").alias(mark)).where(F.col(mark).isNotNull()).distinct())
        s = spans.join(names, lower_strip(spans["term"]) == F.col(mark), "left")
    else:
        s = spans.withColumn(mark, F.lit(None).cast("string"))
    s = s.withColumn(part, cut("term"))
    safe, start = F.col(mark).isNotNull(), F.col("start") + F.col(f"{part}.at")
    cols = {"start": F.when(safe, F.col("start")).otherwise(start), "end": F.when(safe, F.col("end")).otherwise(start + F.length(f"{part}.kept")), "term": F.when(safe, strip("term")).otherwise(F.col(f"{part}.kept"))}
    s = s.where(F.when(safe, ~is_blank("term")).otherwise(F.col(f"{part}.kept") != ""))
    return s.select(*[cols[c].cast(spans.schema[c].dataType).alias(c) if c in cols else F.col(c) for c in spans.columns])


def model_entities(preds: DataFrame, known: DataFrame | None, accept_from: float = L.ACCEPT_FROM, key: str = "doc_id") -> DataFrame:
    """Predictions (key, start, end, term, category, confidence) as entities: trimmed, clamped, routed."""
    t = trim_spans(preds.select(key, "start", "end", "term", "category", "confidence"), known, key)
    return t.withColumn("confidence", L.clamp_confidence("confidence")).withColumn("source", F.lit("ML")).withColumn("status", L.route("confidence", accept_from))


def beam_confidence(beams: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans with the sum of the probabilities p of the beams (key, beam, start, end, category, p) that hold an overlapping span of the label, clamped."""
    met = overlap_join(spans, beams, key)
    once = met.groupBy(*spans.columns, "r_beam").agg(F.max(F.when(F.col("r_category") == F.col("category"), F.col("r_p"))).alias("p"))
    return once.groupBy(*spans.columns).agg(L.clamp_confidence(F.sum("p")).alias("confidence"))


def resolve_conflicts(ml: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(entities, events) of model and dictionary entities (key and ENTITY).

    A dictionary span is accepted if it meets no model span or is longer than all it meets, which it then replaces. Otherwise the model spans it meets
    take its category (of several such dictionary spans the last counts), confidence and status as they were. A dictionary span that only
    meets model spans which a longer one replaced disappears. Of equal spans the first stays, model before dictionary.
    Each change of a category is an event with term, both labels, the winner and offsets. Spans must be unique by
    (start, end) on each side; dictionary order is by start.
    """
    d = dictionary.select(key, *ENTITY).withColumn("_d", F.struct("start", "end"))
    m = ml.select(key, *ENTITY)
    met = overlap_join(d, m, key)
    longest = Window.partitionBy(key, "start", "end")
    met = met.withColumn("_longest", F.max(F.col("r_end") - F.col("r_start")).over(longest)).withColumn("_wins", F.col("_longest").isNull() | (F.col("end") - F.col("start") > F.col("_longest")))
    accepted = met.where("_wins").select(key, *ENTITY).distinct()
    pairs = met.where(F.col("r_start").isNotNull())
    by_span = pairs.groupBy(key, "r_start", "r_end").agg(
        F.bool_or("_wins").alias("_replaced"),
        F.max_by(F.when(~F.col("_wins"), F.col("category")), F.when(~F.col("_wins"), F.col("_d"))).alias("_link"),
    )
    m2 = m.join(by_span.select(F.col(key), F.col("r_start").alias("start"), F.col("r_end").alias("end"), "_replaced", "_link"), [key, "start", "end"], "left")
    m2 = m2.where(~F.coalesce("_replaced", F.lit(False)))
    changed = F.coalesce(F.col("_link") != F.col("category"), F.lit(False))
    event = lambda term, mine, theirs, start, end: [F.col(key), F.col(term).alias("term"), F.col(mine).alias("ml_label"), F.col(theirs).alias("dict_label"), F.col(theirs).alias("winning_label"), F.col(start).alias("start"), F.col(end).alias("end")]
    events = m2.where(changed).select(*event("term", "category", "_link", "start", "end"))
    events = events.unionByName(pairs.where("_wins and r_category <> category").select(*event("term", "r_category", "category", "start", "end")))
    survivors = m2.select(key, "start", "end", "term", F.when(changed, F.col("_link")).otherwise(F.col("category")).alias("category"), "confidence", F.when(changed, "dictionary").otherwise(F.col("source")).alias("source"), "status", F.lit(0).alias("_side"))
    both = survivors.unionByName(accepted.withColumn("_side", F.lit(1)))
    first = both.groupBy(key, "start", "end").agg(F.min_by(F.struct(*[c for c in ENTITY if c not in ("start", "end")]), "_side").alias("e"))
    return first.select(key, "start", "end", "e.*"), events


def with_sentences(events: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Events of the override log: with the text they are from, and a time stamp."""
    return events.join(docs.select(key, F.col(text).alias("sentence")), key).withColumn("timestamp", F.current_timestamp())


def merge_adjacent(entities: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", leading: Sequence[str] = LEADING_TRIM, trailing: Sequence[str] = TRAILING_TRIM, accept_from: float = L.ACCEPT_FROM) -> DataFrame:
    """Neighbours of one category with nothing but white space between become one span.

    Not if the latter is a trailing word or the former a leading one. The confidence is the least (four decimals), the source ML if any is, the
    status goes by the new confidence. Spans are folded in their order, so a merged span is compared as merged; a span that overlaps the one
    before has an empty gap and merges too, with its own end.
    """
    e = entities.select(key, F.struct("start", "end", "category", "confidence", "source", "status", "term").alias("e"))
    grouped = e.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es")).join(docs.select(key, F.col(text).alias("_text")), key)
    lead, trail = frozenset(leading), frozenset(trailing)
    def fold(spans: list[dict], whole: str) -> list[dict]:
        out: list[dict] = []
        for x in spans:
            prev = out[-1] if out else None
            if prev and prev["category"] == x["category"] and not whole[prev["end"] : x["start"]].strip() and x["term"].strip().lower() not in trail and prev["term"].strip().lower() not in lead:
                least = min(c for c in (prev["confidence"], x["confidence"], 1.0) if c is not None)
                source = "ML" if "ML" in (prev["source"], x["source"]) else "dictionary"
                status = L.ACCEPTED if least >= accept_from else L.NEEDS_REVIEW
                out[-1] = x | {"start": prev["start"], "confidence": round(least, 4), "source": source, "status": status, "term": whole[prev["start"] : x["end"]]}
            else:
                out.append(x)
        return out

    def run(batches):
        for batch in batches:
            es = batch.column("es")
            merged = [fold(own, whole or "") for own, whole in zip(es.to_pylist(), batch.column("_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(merged, es.type)], [key, "es"])

    out = grouped.select(key, "es", "_text").mapInArrow(run, grouped.select(key, "es").schema)
    return out.select(key, F.explode("es").alias("e")).select(key, "e.*")


def extract(docs: DataFrame, preds: DataFrame | None, terms: DataFrame | None, mode: str = "hybrid", accept_from: float = L.ACCEPT_FROM, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(entities, override events) of documents: model spans, dictionary spans, or both with conflicts resolved.

    After that neighbours are merged and spans trimmed once more; known terms are the dictionary's. found: the stored dictionary_entities, if they are
    there already.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    known = None if terms is None else terms.select(F.lower("term").alias("term")).distinct()
    events = None
    if mode == "entity_ruler_only":
        found = found or dictionary_entities(docs, terms, key, text)
    elif mode == "transformer_only":
        found = model_entities(preds, known, accept_from, key)
    else:
        scratch = Scratch(docs.sparkSession, "extract")  # both sides are read several times below
        ml = scratch.save(trim_spans(model_entities(preds, known, accept_from, key), None, key), "model")
        found, events = resolve_conflicts(ml, found or scratch.save(dictionary_entities(docs, terms, key, text), "dictionary"), key)
    merged = merge_adjacent(found.select(key, *ENTITY), docs, key, text, accept_from=accept_from)
    return trim_spans(merged.select(key, *ENTITY), known, key), events
