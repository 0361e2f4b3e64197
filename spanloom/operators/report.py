"""Diagnostics, per-document rollups, model alignment and review helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.labels import SPAN_LABELS, percentage, ratio


def diagnostics(records: DataFrame, labels: Column | str, band: tuple[float, float] = (25.0, 35.0), most_times: float = 2.0) -> DataFrame:
    """One row: records, positives, negatives, the negatives' percentage (one decimal), label counts, and whether they are in balance.

    labels: an array per record; null counts as empty, a null label as UNKNOWN.
    """
    ls = F.coalesce(F.col(labels) if isinstance(labels, str) else labels, F.array().cast("array<string>"))
    r = records.select(ls.alias("ls"))
    one = r.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("ls") > 0).alias("positives"), F.count_if(F.size("ls") == 0).alias("negatives")).withColumn("_one", F.lit(1))
    c = r.select(F.explode("ls").alias("l")).groupBy(F.coalesce("l", F.lit("UNKNOWN")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    c = c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"), F.max("n").alias("_hi"), F.min("n").alias("_lo"), F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
    d = one.join(c, "_one").withColumn("negative_pct", percentage("negatives", "total", 1))
    return d.select("total", "positives", "negatives", "negative_pct", F.col("negative_pct").between(*band).alias("in_band"), "label_counts", ((F.col("_k") > 1) & (F.round(F.try_divide("_hi", "_lo"), 2) > most_times)).alias("imbalanced"))


def composition(records: DataFrame, labels: Column | str, band: tuple[float, float] = (0.25, 0.35), least_share: float = 0.45, names: tuple[str, ...] = SPAN_LABELS) -> DataFrame:
    """Shares against targets, unrounded: the negatives' part, each label's share, and warnings."""
    ls = F.coalesce(F.col(labels) if isinstance(labels, str) else labels, F.array().cast("array<string>"))
    count = lambda n: F.sum(F.size(F.filter(ls, lambda x: x == n)))
    per = [count(n).alias(n) for n in names]
    c = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size(ls) == 0).alias("negatives"), *per)
    both = sum((F.col(n) for n in names), F.lit(0))
    c = c.withColumn("negative_ratio", ratio("negatives", "total"))
    for n in names:
        c = c.withColumn(f"{n}_share", ratio(n, both))
    low = F.lit(False)
    for n in names:
        low = low | (F.col(f"{n}_share") < least_share)
    return c.withColumn("negatives_off", ~F.col("negative_ratio").between(*band)).withColumn("labels_off", low)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def status_rollup(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Per item its most telling status: boundary, missed, spurious, another error, correct."""
    s = statuses.groupBy(*keys).agg(F.collect_set("status").alias("s"))
    has = lambda x: F.array_contains("s", x)
    return s.select(*keys, F.when(has("boundary_error"), "boundary").when(has("false_negative"), "missed").when(has("false_positive"), "spurious").when(has("label_error"), "error").when(has("correct"), "correct").otherwise("-").alias("rollup"))


def banner(statuses: DataFrame) -> DataFrame:
    """Counts of gold spans and of each error, and the share of gold spans that are correct."""
    n = lambda x: F.count_if(F.col("status") == x)
    b = statuses.agg(F.count_if(F.col("type") == "gold").alias("gold"), n("correct").alias("correct"), n("boundary_error").alias("boundary"), n("false_positive").alias("spurious"), n("false_negative").alias("missed"))
    return b.withColumn("accuracy", ratio("correct", "gold"))


def align_models(base: DataFrame, second: DataFrame, third: DataFrame, key: str = "doc_id") -> DataFrame:
    """Errors of three models on the base's items and what they have in common; tables (key, errors), a missing item has none."""
    rows = base.select(key, F.col("errors").alias("base"))
    for name, df in (("second", second), ("third", third)):
        rows = rows.join(df.select(key, F.col("errors").alias(name)), key, "left").na.fill(0, [name])
    b, s, t = F.col("base"), F.col("second"), F.col("third")
    consensus = F.when((t == 0) & (b > 0), "fixed").when((b == 0) & (s == 0) & (t == 0), "all_correct").when((b > 0) & (s > 0) & (t > 0), "all_wrong").otherwise("divergent")
    return rows.withColumn("consensus", consensus)


def next_error(items: DataFrame, after: int, order: str = "idx") -> DataFrame:
    """The first item behind a place that has an error."""
    return items.where(F.col("has_error") & (F.col(order) > after)).agg(F.min(order).alias(order))


def boundary_text(gs: str, ge: str, ps: str, pe: str) -> Column:
    """How a predicted span differs from the gold one, in words."""
    gs, ge, ps, pe = map(F.col, (gs, ge, ps, pe))
    side = lambda n, short, long: F.when(n > 0, F.concat(F.lit(short + " "), n.cast("string"))).when(n < 0, F.concat(F.lit(long + " "), (-n).cast("string")))
    parts = F.concat_ws(" | ", side(ps - gs, "prefix missed", "prefix added"), side(ge - pe, "suffix missed", "suffix added"))
    return F.when(gs.isNull() & ps.isNull(), "-").when(gs.isNull(), "spurious").when(ps.isNull(), "missed").when((gs == ps) & (ge == pe), "exact").otherwise(parts)


def nearest_place(places: Column | str, near: Column | str) -> Column:
    """Of an array of starts, the one nearest to near (the first of equals); the only one whatever near is."""
    p, n = (F.col(x) if isinstance(x, str) else x for x in (places, near))
    best = F.array_min(F.transform(p, lambda s: F.struct(F.abs(s - F.coalesce(n, s)).alias("d"), s.alias("s"))))["s"]
    return best


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query in any of the columns, case aside."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return rows.where(cond)


@F.pandas_udf(IntegerType())
def _place_near(text: pd.Series, term: pd.Series, near: pd.Series) -> pd.Series:
    """The start of a term in a text that is nearest to near: places as written, or else in any case."""
    out = []
    for t, w, n in zip(text, term, near, strict=True):
        found: list[int] = []
        for own, part in ((t, w), (t and t.lower(), w and w.lower())):
            at = own.find(part) if own and part and not found else -1
            while at >= 0:
                found.append(at)
                at = own.find(part, at + 1)
        out.append(min(found, key=lambda s: (abs(s - (s if pd.isna(n) else n)), s)) if found else None)
    return pd.Series(out, dtype="Int32")


def enrich_offsets(statuses: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """statuses (as of classify_status) with missing offsets of named predictions filled in: the place of the term nearest to the gold span."""
    own = statuses.join(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), F.col(key) == F.col("_k"), "left")
    own = own.withColumn("_at", F.when(F.col("pred_start").isNull() & F.col("pred_term").isNotNull(), _place_near("_t", "pred_term", "gold_start")))
    fill = {"pred_start": F.coalesce("pred_start", "_at"), "pred_end": F.coalesce("pred_end", F.col("_at") + F.length("pred_term"))}
    return own.select(*[fill[c].cast(statuses.schema[c].dataType).alias(c) if c in fill else F.col(c) for c in statuses.columns])


def filter_documents(items: DataFrame, query: str | None = None, status: str | None = None, label: str | None = None, source: str | None = None) -> DataFrame:
    """Items (text, entity_results) that satisfy all conditions given: the query in the text or a gold or predicted term, in any case; a result of
    the status; the label on either side; the prediction's source."""
    r, out = F.col("entity_results"), items
    if query is not None:
        held = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
        out = out.where(held("text") | F.exists(r, lambda x: held(x["gold_term"]) | held(x["pred_term"])))
    if status is not None:
        out = out.where(F.exists(r, lambda x: x["status"] == status))
    if label is not None:
        out = out.where(F.exists(r, lambda x: F.coalesce(x["gold_label"] == label, F.lit(False)) | F.coalesce(x["pred_label"] == label, F.lit(False))))
    return out if source is None else out.where(F.exists(r, lambda x: F.coalesce(x["pred_source"] == source, F.lit(False))))


def sort_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column: numbers by value, whatever the column's type, before other texts by code points; nulls last."""
    number = F.col(column).cast("string").try_cast("double")
    keys = (number, F.col(column).cast("string"))
    return rows.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys])


def lift(value: Column | str, base: Column | str) -> Column:
    """The difference of two percentages as a report writes it."""
    from ..functions.labels import signed

    return signed((F.col(value) if isinstance(value, str) else value) - (F.col(base) if isinstance(base, str) else base))


def prompts(terms: DataFrame, examples: DataFrame, forbidden: DataFrame, size: int = 10) -> DataFrame:
    """One row (prompt): a request for annotated sentences, put together from sampled terms (label, term), examples (text, entities as JSON) and terms to avoid (term).

    The tables are samples (see split.seeded_sample), so the text stays short.
    """
    listed = terms.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("t"))
    a = listed.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "label", "t"))), "\n").alias("a")).withColumn("_one", F.lit(1))
    b = examples.agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("text", "entities")))), "\n").alias("b")).withColumn("_one", F.lit(1))
    c = forbidden.agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("c")).withColumn("_one", F.lit(1))
    parts = [F.lit(f"Write {size} short work-journal sentences as a JSON array of objects with text and entities."), F.concat(F.lit("Terms by label:\n"), "a"), F.concat(F.lit("Examples:\n"), "b"), F.concat(F.lit("Do not use: "), "c")]
    return a.join(b, "_one").join(c, "_one").select(F.concat_ws("\n\n", *parts).alias("prompt"))
