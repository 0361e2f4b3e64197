"""Curation edits over whole span tables, and consistency audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import span_slice
from .dictionary import filter_spans, match_terms
from .overlaps import overlap_join
from .scratch import Scratch

WHOLE = ["start", "end", "label"]


def occurrences(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, surface): every place of a term in any case, at word ends."""
    t = docs.sparkSession.createDataFrame([(term, "", 1)], "term string, label string, ord int")
    return match_terms(docs, t, key, text).select(key, "start", "end", F.col("term").alias("surface"))


def sync_terms(docs: DataFrame, spans: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, changes) after each term of terms (term, label) got its label everywhere.

    Each place of a term, in any case and at word ends, is relabelled if a span stands exactly there, skipped if another span
    overlaps it, else added. A place counts as exact if its span comes before any overlapping one by start. Places that would be added are taken
    longest first, then by start, so that none overlaps another. changes: (key, start, end, label, action).
    """
    listed = terms.select(F.lower("term").alias("term"), "label").groupBy("term").agg(F.min("label").alias("label")).withColumn("ord", F.lit(1))
    scratch = Scratch(docs.sparkSession, "sync")  # texts and spans are read once, what comes of them several times below
    places = match_terms(docs, listed, key, text).select(key, "start", "end", F.col("label").alias("pl"))
    spot = F.struct(F.col("r_start"), F.col("r_end"), F.col("r_label"))
    met = overlap_join(places, spans.select(key, *WHOLE), key)
    every = met.groupBy(key, "start", "end", "pl").agg(F.min(F.when(F.col("r_start").isNotNull(), spot)).alias("m"))
    exact = (F.col("m.r_start") == F.col("start")) & (F.col("m.r_end") == F.col("end"))
    action = F.when(F.col("m").isNull(), "added").when(exact & (F.col("m.r_label") != F.col("pl")), "relabelled").when(exact, "same").otherwise("skipped")
    changes = scratch.save(every.select(key, "start", "end", F.col("pl").alias("label"), action.alias("action")), "changes")
    free = scratch.save(filter_spans(changes.where("action = 'added'").select(key, "start", "end", "label"), key), "free")
    clash = changes.where("action = 'added'").join(free, [key, "start", "end"], "left_anti").withColumn("action", F.lit("skipped"))
    changes = changes.where("action <> 'added'").unionByName(free.withColumn("action", F.lit("added"))).unionByName(clash)
    relabelled = changes.where("action = 'relabelled'").select(key, "start", "end", F.col("label").alias("_new"))
    kept = spans.join(relabelled, [key, "start", "end"], "left").withColumn("label", F.coalesce("_new", "label")).select(*spans.columns)
    added = changes.where("action = 'added'").select(key, "start", "end", "label")
    if "term" in spans.columns:
        added = added.join(docs.select(key, F.col(text).alias("_text")), key).select(key, "start", "end", "label", span_slice("_text", "start", "end").alias("term"))
    return kept.unionByName(added, allowMissingColumns=True), changes


def sync_add(docs: DataFrame, spans: DataFrame, term: str, label: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """sync_terms for one term; changes without the label."""
    one = docs.sparkSession.createDataFrame([(term, label)], "term string, label string")
    new, changes = sync_terms(docs, spans, one, key, text)
    return new, changes.drop("label")


def change_counts(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """added, relabelled, and records affected."""
    did = F.col("action").isin("added", "relabelled")
    return changes.agg(F.count_if(F.col("action") == "added").alias("added"), F.count_if(F.col("action") == "relabelled").alias("relabelled"), F.count_distinct(F.when(did, F.col(key))).alias("affected"))


def sync_delete(spans: DataFrame, term: str) -> DataFrame:
    """Spans whose surface (term) isn't the given one, case aside."""
    return spans.where(F.lower("term") != term.lower())


def sync_edit(docs: DataFrame, spans: DataFrame, old: str, new: str, label: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The same term gets the label everywhere; another one replaces the old term's spans by its own places."""
    if old.lower() == new.lower():
        own = F.lower("term") == old.lower()
        changes = spans.where(own & (F.col("label") != label)).select(key, "start", "end", F.lit("relabelled").alias("action"))
        return spans.withColumn("label", F.when(own, label).otherwise(F.col("label"))), changes
    return sync_add(docs, sync_delete(spans, old), new, label, key, text)


def consistency(spans: DataFrame, order: Column | str) -> DataFrame:
    """Terms with more than one label: their labels' counts, total and majority label (a tie goes to the label met first)."""
    o = F.col(order) if isinstance(order, str) else order
    c = spans.groupBy(F.lower("term").alias("term"), "label").agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("first"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("first"))
    t = c.groupBy("term").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("total"), F.min_by("label", rank).alias("majority"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("counts"))
    return t.where("n_labels > 1")


def resolve_to_majority(docs: DataFrame, spans: DataFrame, order: Column | str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, changes) after every term with several labels got the majority's at all its places; places without a label get it too (see sync_terms)."""
    return sync_terms(docs, spans, consistency(spans, order).select("term", F.col("majority").alias("label")), key, text)


def impact(spans: DataFrame, term: str, key: str = "doc_id") -> DataFrame:
    """Occurrences of a surface and records that hold it."""
    own = spans.where(F.lower("term") == term.lower())
    return own.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(key).alias("records"))


def set_entity(spans: DataFrame, doc: int, start: int, end: int, label: str | None, key: str = "doc_id") -> DataFrame:
    """One document's span set to a label, or removed if label is null; refused (unchanged) if it is new and overlaps another."""
    at = (F.col(key) == doc) & (F.col("start") == start) & (F.col("end") == end)
    rest = spans.where(~at)
    if label is None:
        return rest
    clash = rest.where((F.col(key) == doc) & (F.greatest("start", F.lit(start)) < F.least("end", F.lit(end)))).limit(1)
    new = spans.sparkSession.createDataFrame([(doc, start, end, label)], ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in (key, *WHOLE)))
    return rest.unionByName(new.join(clash.select(F.lit(1)), how="left_anti"), allowMissingColumns=True)


def add_record(records: DataFrame, doc: int, text: str, key: str = "doc_id") -> DataFrame:
    """A record more, with its text stripped and without entities."""
    new = records.sparkSession.createDataFrame([(doc, text.strip())], f"{key} {records.schema[key].dataType.simpleString()}, text string")
    return records.unionByName(new, allowMissingColumns=True)


def invalid_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans outside their text, or with the end before the start."""
    return spans.join(docs.select(key, F.length(text).alias("_n")), key).where(~((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_n")))).drop("_n")


def policy_report(docs: DataFrame, spans: DataFrame, leading: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Violations of annotation policy: (key, start, end, rule)."""
    s = spans.join(docs.select(key, F.col(text).alias("_text")), key)
    word = r"^[\p{L}\p{N}_]$"
    char = lambda at: F.substring("_text", at, 1)
    inside = (F.when(F.col("start") > 0, char(F.col("start"))).otherwise("").rlike(word) & char(F.col("start") + 1).rlike(word)) | (char(F.col("end")).rlike(word) & char(F.col("end") + 1).rlike(word))
    first = F.lower(F.element_at(F.split("term", r"\s+"), 1))
    rules = {"cuts_word": inside, "starts_with_listed_word": first.isin(*leading), "ends_with_mark": F.col("term").rlike(r"([.,:;!?()'\"]|'s)$")}
    found = s.select(key, "start", "end", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    a, b = spans.select(key, "start", "end"), spans.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    over = a.join(b, (F.col(key) == F.col("_k")) & (F.greatest("start", "_s") < F.least("end", "_e")) & (F.struct("start", "end") < F.struct("_s", "_e")))
    return found.unionByName(over.select(key, "start", "end", F.lit("overlap").alias("rule")).distinct())
