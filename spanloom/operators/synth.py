"""Acceptance of generated texts: relocating entities, parsing responses, quality filters, curation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.config import LABEL_KEYS, RECORD_KEYS, SECOND_LABEL_WORDS, SURFACE_KEYS
from ..functions.labels import SPAN_LABELS
from .dedup import deduplicate_accepted, first_row

SPANS = "array<struct<start:int,end:int,label:string>>"


def places(text: str, surface: str) -> Iterator[int]:
    """Starts of a surface in a text, left to right: exact ones, then, where none is left, ones in any case."""
    at, low, part = 0, text.lower(), surface.lower()
    plain = len(low) == len(text)
    while at < len(text):
        found = text.find(surface, at)
        if found < 0:
            found = low.find(part, at) if plain else next((i for i in range(at, len(text)) if text[i : i + len(surface)].lower() == part), -1)
        if found < 0:
            return
        yield found
        at = found + 1


def place_all(text: str, wanted: Sequence[tuple[str, str]]) -> list[dict] | None:
    """Spans for (surface, label) pairs in their order: the first place with no letter or digit at either side that is
    still free; None if a surface is blank or finds no place. An underscore at a side does no harm."""
    free = bytearray(len(text))
    out = []
    for surface, label in wanted:
        if not surface.strip():
            return None
        for s in places(text, surface):
            e = s + len(surface)
            if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) or any(free[s:e]):
                continue
            free[s:e] = b"\x01" * (e - s)
            out.append({"start": s, "end": e, "label": label})
            break
        else:
            return None
    return sorted(out, key=lambda x: x["start"])


def relocate(candidates: DataFrame, source_text: str = "source_text", text: str = "text", entities: str = "entities") -> DataFrame:
    """candidates with the source's entities placed in the new text (entities), or null if any finds no place."""

    def run(frames):
        for pdf in frames:
            out = []
            for src, txt, ents in zip(pdf[source_text], pdf[text], pdf[entities], strict=True):
                ents = [] if ents is None else list(ents)
                out.append(None if txt is None or src is None else place_all(txt, [(src[x["start"] : x["end"]], x["label"]) for x in ents]))
            pdf[entities] = out
            yield pdf

    fields = ", ".join(f"`{f.name}` {SPANS if f.name == entities else f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, fields)


#: Words that stand for "no entity" in generated answers (lower case).
NO_ENTITY = ("", "none", "null", "[]", "{}", "no entities")


def json_values(raw: str) -> Iterator:
    """Every JSON object or array in a text, left to right, whatever stands around them; what lies inside one is not given again.

    RecursionError if one is nested more deeply than the decoder goes.
    """
    read, at = json.JSONDecoder().raw_decode, 0
    while at < len(raw):
        if raw[at] in "[{":
            try:
                value, at = read(raw, at)
                yield value
                continue
            except ValueError:
                pass
        at += 1


def _first_of(item: dict, names: Sequence[str]) -> str:
    return next((str(item[n]).strip() for n in names if item.get(n)), "")


def _marked(own: str, marks: Sequence[str]) -> tuple[str, str]:
    """(surface, label) of a string that may carry a label at its beginning or its end, set off by white space, colons or dashes."""
    parts = re.split(r"([\s:\-]+)", own)
    known = {m.upper() for m in marks}
    if len(parts) > 2 and parts[0].upper() in known:
        return "".join(parts[2:]), parts[0]
    if len(parts) > 2 and parts[-1].upper() in known:
        return "".join(parts[:-2]), parts[-1]
    return own, ""


def entity_items(raw) -> list:
    """What a record names as entities, as a list: a list as it is, an object or a string as one item, and a string that holds JSON as what it holds."""
    if isinstance(raw, str):
        own = raw.strip()
        if own.lower().rstrip(".") in NO_ENTITY:
            return []
        try:
            whole = list(json_values(own)) if own[0] in "[{" and own[-1] in "]}" else []
        except RecursionError:
            whole = []
        return entity_items(whole[0]) if len(whole) == 1 else [own]
    if isinstance(raw, list):
        return [x for x in raw if x and str(x).strip().lower().rstrip(".") not in NO_ENTITY]
    return [raw] if raw else []


def read_entity(raw, marks: Sequence[str] = (*SPAN_LABELS, "IT", "CLERICAL")) -> tuple[str, str] | None:
    """(surface, label) of one entity as a generator may write it: an object, the same as JSON text, or a
    string with the label before or after it; None if it names nothing."""
    items = entity_items(raw) if isinstance(raw, str) else [raw]
    if len(items) != 1:
        return None
    if isinstance(items[0], dict):
        surface, label = _first_of(items[0], SURFACE_KEYS), _first_of(items[0], LABEL_KEYS)
    elif isinstance(items[0], str):
        surface, label = _marked(items[0].strip(), marks)
        surface = surface.strip().strip("'\"`")
    else:
        return None
    return (surface, label) if surface else None


def guess_label(raw: str, surface: str, second_words: Sequence[str] = SECOND_LABEL_WORDS) -> str:
    """The label that loose text means; see functions.labels.infer_label."""
    up, low = raw.strip().upper(), surface.lower()
    if "IT" in up:
        return SPAN_LABELS[0]
    return SPAN_LABELS[1] if "CLERICAL" in up or any(w in low for w in second_words) else SPAN_LABELS[0]


def _records(value) -> list | None:
    """The records in a decoded answer: a list that holds an object, the list that an object wraps, or an object that is a record itself."""
    if isinstance(value, list):
        return value if any(isinstance(x, dict) for x in value) else None
    wrapped = [value[k] for k in RECORD_KEYS if isinstance(value.get(k), list)]
    return wrapped[0] if wrapped else [value] if "text" in value else None


#: Why an answer has no record.
EMPTY, NO_JSON, NO_RECORDS, TOO_DEEP = "empty", "no_json", "no_records", "too_deep"


def read_answer(raw: str | None) -> tuple[list, str | None]:
    """(records, reason) of a generator's answer: the records of the first JSON value that holds any, be it fenced, bare or in the middle of
    prose, past values that hold none; without records, the reason. A value nested too deeply ends an answer, not the job."""
    if not (raw or "").strip():
        return [], EMPTY
    any_json = False
    try:
        for value in json_values(raw):
            any_json = True
            found = [r for r in _records(value) or () if isinstance(r, dict) and isinstance(r.get("text"), str)]
            if found:
                return _records(value), None
    except RecursionError:
        return [], TOO_DEEP
    return [], NO_RECORDS if any_json else NO_JSON


def read_response(raw: str) -> list:
    """The records of read_answer."""
    return read_answer(raw)[0]


def failed_responses(responses: DataFrame, key: str = "response_id", raw: str = "raw") -> DataFrame:
    """(key, reason) of the answers that hold no record: empty, no_json, no_records or too_deep."""

    def run(frames):
        for pdf in frames:
            pdf["reason"] = [read_answer(x)[1] for x in pdf[raw]]
            yield pdf.loc[pdf["reason"].notna(), [key, "reason"]]

    kind = responses.schema[key].dataType.simpleString()
    return responses.select(key, raw).mapInPandas(run, f"{key} {kind}, reason string")


def parse_responses(responses: DataFrame, key: str = "response_id", raw: str = "raw") -> DataFrame:
    """(key, idx, text, entities) of the records in raw answers; entities is null where one that is named finds no place."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, answer in zip(pdf[key], pdf[raw], strict=True):
                for i, rec in enumerate(read_response(answer or "")):
                    text = rec.get("text") if isinstance(rec, dict) else None
                    if not isinstance(text, str):
                        continue
                    items = entity_items(rec.get("entities"))
                    named = [x for x in map(read_entity, items) if x]
                    spans = (None if items else []) if not named else place_all(text, [(s, guess_label(lab, s)) for s, lab in named])
                    rows.append((k, i, text, spans))
            yield pd.DataFrame(rows, columns=[key, "idx", "text", "entities"])

    kind = responses.schema[key].dataType.simpleString()
    return responses.select(key, raw).mapInPandas(run, f"{key} {kind}, idx int, text string, entities {SPANS}")


def surfaces(text: str = "text", entities: str = "entities") -> Column:
    """Lower-cased, stripped surfaces of a record's entities."""
    return F.transform(F.coalesce(F.col(entities), F.array().cast(SPANS)), lambda e: T.lower_strip(T.span_slice(F.col(text), e["start"], e["end"])))


def quality_reason(blocked: Sequence[str] = (), bare: Sequence[str] = (), longest: int = 500, endings: Sequence[str] = (" script", " software", " tool"), exempt: Sequence[str] = (), text: str = "text", entities: str = "entities") -> Column:
    """Why a generated record is rejected, or null: length, a blank span, a blocked, bare or loosely ending surface, entities that found no place."""
    s = surfaces(text, entities)
    size = F.length(T.strip(text))
    listed = [*blocked, *bare]
    loose = F.lit(False)
    for e in endings:
        loose = loose | F.exists(F.filter(s, lambda x: ~x.isin(*exempt)) if exempt else s, _ends(e))
    return (
        F.when(F.col(entities).isNull(), "relocation").when((size < 10) | (F.length(text) > longest), "length").when(F.exists(s, lambda x: x == ""), "empty_span")
        .when(F.exists(s, lambda x: x.isin(*listed)) if listed else F.lit(False), "blocked_term").when(loose, "loose_ending")
    )


def _ends(suffix: str):
    return lambda x: F.endswith(x, F.lit(suffix))


def accept_candidates(candidates: DataFrame, protected: DataFrame, reason: Column) -> DataFrame:
    """One paraphrase per source: the best-ranked candidate (source_id, rank, source_text, text, entities) that relocates,
    passes reason, and is neither protected nor an accepted candidate of a source before it."""
    moved = relocate(candidates).withColumn("_reason", reason).where("_reason is null").drop("_reason")
    free = moved.join(protected.select(F.col("key").alias("_key")), T.lower_strip("text") == F.col("_key"), "left_anti")
    best = first_row(free, ["source_id"], "rank")
    return first_row(best, [T.lower_strip("text")], "source_id")


def accept_generated(responses: DataFrame, protected: DataFrame, banned_terms: DataFrame | None, reason: Column, key: str = "response_id") -> DataFrame:
    """Generated records that pass reason, hold no banned term and are not protected; copies of an accepted text go."""
    rows = parse_responses(responses, key).withColumn("rec", F.struct(key, "idx")).withColumn("_reason", reason)
    free = rows.join(protected.select(F.col("key").alias("_key")), T.lower_strip("text") == F.col("_key"), "left_anti")
    if banned_terms is not None:
        from .leakage import terms_in_texts

        held = terms_in_texts(free.select("rec", "text"), banned_terms, "rec").select("rec").distinct()
        free = free.join(held, "rec", "left_anti")
    return deduplicate_accepted(free, F.col("_reason").isNull(), "rec").drop("_reason", "rec")


def curation_reasons(rows: DataFrame, seen: DataFrame, test: DataFrame, dev: DataFrame, terms: DataFrame, order: str, text: str = "text") -> DataFrame:
    """rows with a reason: duplicate, test_leak, dev_leak, accidental_entity or accept, the first that holds."""
    from .leakage import terms_in_texts

    key = lambda df: df.select(T.strip("text").alias("_k")).distinct()
    keyed = rows.withColumn("_k", T.strip(text))
    first = keyed.groupBy("_k").agg(F.min(order).alias("_first"))
    out = keyed.join(first, "_k")
    for name, df in (("seen", seen), ("test", test), ("dev", dev)):
        out = out.join(key(df).withColumn(f"_{name}", F.lit(True)), "_k", "left")
    held = terms_in_texts(rows.select(F.col(order).alias("_rec"), F.col(text).alias("text")), terms, "_rec").select(F.col("_rec").alias(order)).distinct().withColumn("_term", F.lit(True))
    out = out.join(held, order, "left")
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when((F.col(order) != F.col("_first")) | is_true("_seen"), "duplicate").when(is_true("_test"), "test_leak").when(is_true("_dev"), "dev_leak").when(is_true("_term"), "accidental_entity").otherwise("accept")
    return out.select(*rows.columns, reason.alias("reason"))
