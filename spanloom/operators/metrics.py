"""Span evaluation: status classification, matching, precision, recall and F1, calibration, cross-validation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ratio
from .overlaps import overlap_join


def classify_status(gold: DataFrame, preds: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each gold span, and for each prediction that meets none: its status.

    gold: (key, idx, start, end, label, term); preds: (key, idx, start, end, label, term). A gold span is correct or a label_error by the first prediction with its
    offsets; else a boundary_error with the last prediction that overlaps it; else a false_negative. Predictions that stand after the
    exact one, or overlap no gold span, are false_positives.
    """
    p = preds.select(key, F.col("idx").alias("p_idx"), "start", "end", F.col("label").alias("p_label"), F.col("term").alias("p_term"))
    met = overlap_join(gold, p, key)
    exact = (F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end"))
    own = Window.partitionBy(key, "idx")
    met = met.withColumn("_x", F.min(F.when(exact, F.col("r_p_idx"))).over(own)).withColumn("_seen", F.col("r_p_idx") <= F.coalesce("_x", "r_p_idx"))
    best = met.where("r_p_idx is null or _seen").groupBy(key, "idx", "start", "end", "label", "term").agg(
        F.max("_x").alias("_x"), F.max("r_p_idx").alias("pred_idx"), F.max_by(F.struct(F.col("r_p_label").alias("label"), F.col("r_p_term").alias("term"), F.col("r_start").alias("start"), F.col("r_end").alias("end")), "r_p_idx").alias("p")
    )
    status = F.when(F.col("_x").isNotNull(), F.when(F.col("p.label") == F.col("label"), "correct").otherwise("label_error")).when(F.col("pred_idx").isNotNull(), "boundary_error").otherwise("false_negative")
    golds = best.select(key, F.lit("gold").alias("type"), status.alias("status"), F.col("start").alias("gold_start"), F.col("end").alias("gold_end"), F.col("label").alias("gold_label"), F.col("term").alias("gold_term"), F.col("p.start").alias("pred_start"), F.col("p.end").alias("pred_end"), F.col("p.label").alias("pred_label"), F.col("p.term").alias("pred_term"))
    used = met.where("_seen").select(F.col(key), F.col("r_p_idx").alias("p_idx")).distinct()
    rest = p.join(used, [key, "p_idx"], "left_anti")
    none = lambda t: F.lit(None).cast(t)
    kinds = dict(golds.dtypes)
    falses = rest.select(key, F.lit("prediction").alias("type"), F.lit("false_positive").alias("status"), *[none(kinds[c]).alias(c) for c in ("gold_start", "gold_end", "gold_label", "gold_term")], F.col("start").alias("pred_start"), F.col("end").alias("pred_end"), F.col("p_label").alias("pred_label"), F.col("p_term").alias("pred_term"))
    return golds.unionByName(falses)


def strict_counts(gold: DataFrame, preds: DataFrame, key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    """(label, tp, fp, fn): spans matched one to one by offsets and label; repeated spans by their number. by: columns of both sides that are counted apart."""
    side = lambda df, c: df.groupBy(*by, key, "start", "end", "label").agg(F.count(F.lit(1)).alias(c))
    both = side(gold, "g").join(side(preds, "p"), [*by, key, "start", "end", "label"], "full").na.fill(0, ["g", "p"])
    return both.groupBy(*by, "label").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def with_overall(counts: DataFrame, label: str = "label", name: str = "ALL") -> DataFrame:
    """Counts per label and their sums as one more row."""
    return counts.rollup(label).agg(*[F.sum(c).alias(c) for c in counts.columns if c != label]).na.fill(name, [label])


def prf(tp: Column | str = "tp", fp: Column | str = "fp", fn: Column | str = "fn") -> list[Column]:
    """precision, recall and f1 of counts, 0 where they are undefined; f1 from the unrounded values."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def rounded_prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """Percentages with two decimals; f1 from the rounded ones."""
    p = F.round(100 * ratio(tp, F.col(tp) + F.col(fp)), 2)
    r = F.round(100 * ratio(tp, F.col(tp) + F.col(fn)), 2)
    return [p.alias("precision"), r.alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 2).alias("f1")]


def lenient_matches(gold: DataFrame, preds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct gold terms with the best prediction of their label: equal, or one holds the other.

    gold: (key, term, label); preds: (key, term, label, confidence). The best is equal, else the longest, else the first by name and confidence.
    """
    g = gold.select(key, F.lower("term").alias("term"), "label").distinct()
    p = preds.select(key, F.lower("term").alias("p_term"), "label", "confidence").distinct()
    hit = (F.col("term") == F.col("p_term")) | F.contains("term", F.col("p_term")) | F.contains("p_term", F.col("term"))
    met = g.join(p, [key, "label"], "left").withColumn("_hit", hit)
    rank = F.struct((F.col("term") != F.col("p_term")).alias("a"), (-F.length("p_term")).alias("b"), F.col("p_term").alias("c"), F.col("confidence").alias("d"))
    best = met.groupBy(key, "term", "label").agg(F.min(F.when(F.col("_hit"), rank)).alias("best"))
    return best.select(key, "term", "label", F.col("best.c").alias("matched"), F.col("best.d").alias("confidence"))


def lenient_counts(gold: DataFrame, preds: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: tp, fp, fn over distinct terms, total_gold as listed, and mean confidences of matched and unmatched predictions."""
    m = lenient_matches(gold, preds, key)
    g = gold.select(key, F.lower("term").alias("term"), "label").distinct()
    p = preds.select(key, F.lower("term").alias("p_term"), "label", "confidence").distinct()
    near = p.join(g, [key, "label"], "left").withColumn("_hit", F.coalesce((F.col("term") == F.col("p_term")) | F.contains("term", F.col("p_term")) | F.contains("p_term", F.col("term")), F.lit(False)))
    used = near.groupBy(key, "p_term", "label", "confidence").agg(F.bool_or("_hit").alias("used"))
    a = m.agg(F.count("matched").alias("tp"), F.count_if(F.col("matched").isNull()).alias("fn"), F.avg(F.when(F.col("matched").isNotNull(), F.col("confidence"))).alias("mean_matched"))
    b = used.agg(F.count_if(~F.col("used")).alias("fp"), F.avg(F.when(~F.col("used"), F.col("confidence"))).alias("mean_unmatched"))
    c = gold.agg(F.count(F.lit(1)).alias("total_gold"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")


def holdout_matches(gold: DataFrame, preds: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gold spans with the first prediction (by idx) of their label that overlaps them or whose term holds, or is held by, theirs.

    Places meet by bins, terms as the distinct ones of a document and label, so repeated terms make no product.
    """
    p = preds.select(key, F.col("idx").alias("p_idx"), "start", "end", F.lower("term").alias("p_term"), F.col("label").alias("p_label"))
    placed = overlap_join(gold, p, key, "inner").where("label = r_p_label").groupBy(key, "idx", "label", "term").agg(F.min("r_p_idx").alias("_by_place"))
    firsts = p.groupBy(key, F.col("p_label").alias("label"), "p_term").agg(F.min("p_idx").alias("p_idx"))
    lowered = gold.select(key, "label", F.lower("term").alias("_low")).distinct()
    named = lowered.join(firsts, [key, "label"]).where(F.contains("_low", F.col("p_term")) | F.contains("p_term", F.col("_low")))
    named = named.groupBy(key, "label", "_low").agg(F.min("p_idx").alias("_by_term"))
    own = gold.select(key, "idx", "label", "term").distinct().withColumn("_low", F.lower("term"))
    same = F.col("o.term").eqNullSafe(F.col("w.term"))
    out = own.alias("o").join(placed.alias("w"), [F.col(f"o.{c}") == F.col(f"w.{c}") for c in (key, "idx", "label")] + [same], "left").select("o.*", "_by_place")
    return out.join(named, [key, "label", "_low"], "left").select(key, "idx", "label", "term", F.least("_by_place", "_by_term").alias("matched_idx"))


def calibration(preds: DataFrame, matched: str = "matched") -> DataFrame:
    """Mean confidence of matched and unmatched predictions, and the difference of the means rounded to four decimals."""
    m = preds.agg(F.round(F.avg(F.when(F.col(matched), F.col("confidence"))), 4).alias("matched_mean"), F.round(F.avg(F.when(~F.col(matched), F.col("confidence"))), 4).alias("unmatched_mean"))
    return m.withColumn("delta", F.col("matched_mean") - F.col("unmatched_mean"))


def metric_stats(results: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation per group; missing values count as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return results.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("n"))


def deltas(results: DataFrame, condition: str, baseline: str, metric: str, value: str) -> DataFrame:
    """Each metric's difference to the baseline condition's."""
    base = results.where(F.col(condition) == baseline).select(metric, F.col(value).alias("_base"))
    return results.join(base, metric).withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


def by_mode(counts: DataFrame, mode: str = "mode") -> DataFrame:
    """Counts (mode, tp, fp, fn) with metrics side by side, and each mode's recall above the dictionary's."""
    m = counts.select(mode, "tp", "fp", "fn", *prf())
    base = m.where(F.col(mode) == "entity_ruler_only").select(F.col("recall").alias("_base"))
    return m.withColumn("_one", F.lit(1)).join(base.withColumn("_one", F.lit(1)), "_one", "left").withColumn("recall_lift", F.col("recall") - F.coalesce("_base", F.lit(0.0))).drop("_one", "_base")


def condition_grid(conditions: DataFrame, folds: int) -> DataFrame:
    """Every condition with every fold."""
    return conditions.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def full_report(strict: DataFrame, modes: DataFrame, holdout: DataFrame) -> DataFrame:
    """(section, name, tp, fp, fn, precision, recall, f1): strict counts (label, tp, fp, fn), counts by mode, and holdout counts by status
    (term_status, tp, fn; no false positives, so no precision), in one table."""
    part = lambda df, section, name: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), "tp", "fp", "fn", *prf())
    none = F.lit(None).cast("double")
    held = holdout.select(F.lit("holdout").alias("section"), F.col("term_status").alias("name"), "tp", F.lit(None).cast("long").alias("fp"), "fn", none.alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), none.alias("f1"))
    return part(strict, "strict", "label").unionByName(part(modes, "mode", "mode")).unionByName(held)


def skipped(name: str, like: DataFrame) -> DataFrame:
    """A report for data that are absent: one row with the status, all counts null."""
    cols = [F.lit("SKIPPED").alias(c) if c == "section" else F.lit(name).alias(c) if c == "name" else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns]
    return like.sparkSession.range(1).select(*cols)
