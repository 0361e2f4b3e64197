"""How filters interact: every document's failures as a bit mask, and what each order of the filters removes at each step."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, text_of

#: White space between words, as a regular expression.
GAP = r"[\x20\x09-\x0D]+"

#: Failure conditions on the columns text, words, n_words, n_distinct of a document.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 100,
    "B": lambda: 100 * F.col("n_distinct") < 80 * F.col("n_words"),
    "C": lambda: 100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
#: The letter of the filter that fails texts which a smaller id has as well.
REPEATS = "E"
#: Output columns that count lost documents, and the labels they are lost by.
LOST: dict[str, Callable[[], Column]] = {"good_lost": lambda: F.col("quality") == 1, "toxic_lost": lambda: F.col("toxic") == 1}


def _bit(k: int, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, lost: Mapping[str, Callable[[], Column]] = LOST, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, hash, mask, one boolean for each name in lost): a thin row per document, joined with its labels.

    Bit k of mask says that the k-th filter fails the whole text; a condition that is null does not fail. A null text or part is empty. A document without
    labels is lost by none, one with several has what any of them says. hash is the SHA-256 of the text.
    """
    text = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"), text_of(quoted(text_col)).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    sized = words.withColumn("n_words", F.size("words").cast("long")).withColumn("n_distinct", F.size(F.array_distinct("words")).cast("long"))
    mask = functools.reduce(Column.bitwiseOR, [_bit(k, fails()) for k, fails in enumerate(filters.values())], F.lit(0))
    thin = sized.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), mask.alias("mask"))
    known = labels.where(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("id"))
    known = known.agg(*[F.coalesce(F.bool_or(c()), F.lit(False)).alias(n) for n, c in lost.items()])
    return thin.join(known, "id", "left").select("id", "part", "hash", "mask", *[F.coalesce(n, F.lit(False)).alias(n) for n in lost])


def mask_cells(masks: DataFrame, bit: int) -> DataFrame:
    """(part, mask, lost columns, n): how many documents share a mask, with the given bit set for repeated texts.

    masks: document_masks. A document repeats another if a smaller id has the same hash, in whatever part; a null id neither
    repeats nor is repeated, and of equal ids with one text none repeats another. Copies are counted per id, then per text, each time combined before the
    shuffle, so a text with any number of copies is a few rows when its least id is looked for; no document meets another.
    """
    what = ["part", "mask", *[c for c in masks.columns if c not in ("id", "part", "hash", "mask")]]
    same = masks.groupBy("id", "hash", *what).agg(F.count(F.lit(1)).alias("n"))
    texts = same.groupBy("hash", *what).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    first = texts.withColumn("first", F.min("least").over(Window.partitionBy("hash")))
    once = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("mask").alias("m"), once.alias("k")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << bit)).alias("m"), (F.col("n") - once).alias("k")))
    cells = first.select(*what, F.explode(split).alias("s")).where("s.k > 0").select(*[c for c in what if c != "mask"], F.col("s.m").alias("mask"), F.col("s.k").alias("n"))
    return cells.groupBy(*what).agg(F.sum("n").alias("n"))


def interactions(cells: DataFrame, letters: str, lost: Mapping[str, object] = LOST) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, lost columns, shapley) for all orders of the filters.

    cells: mask_cells; bit k belongs to letters[k]. Each cell is unfolded into a row for each order and step; a running bit-or over the steps before says
    whether something earlier has removed it. Parts come from the cells, so an empty table has no rows; every other
    part has all orders and steps, zeros included. The work grows with the number of parts and masks, not of documents.
    """
    orders = ["".join(p) for p in itertools.permutations(letters)]
    what = ["part", "mask", *lost]
    rows = cells.select(*what, "n", F.explode(F.lit(orders)).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = rows.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    own = functools.reduce(lambda c, k: c.when(F.col("filter") == letters[k], F.lit(1 << k)), range(1, len(letters)), F.when(F.col("filter") == letters[0], F.lit(1)))
    rows = rows.withColumn("bit", own).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    walk = Window.partitionBy(*what, "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.bit_or("failed").over(walk), F.lit(0)))
    fails, open_ = F.col("failed") != 0, F.col("before") == 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total(open_ & ~fails).alias("kept"), total(open_ & fails).alias("removed"), total(~open_ & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), *[total(open_ & fails & F.col(c)).alias(c) for c in lost],
    )
    steps = steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, filters: Mapping[str, Callable[[], Column]] = FILTERS, repeats: str = REPEATS, lost: Mapping[str, Callable[[], Column]] = LOST, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """interactions of the filters (letter -> failure condition) and of repeated texts (letter repeats) over whole texts.

    Filters are at most six or so: the orders are their factorial. Columns of docs and labels that are not named are not read, so their names don't matter.
    """
    masks = document_masks(docs, labels, filters, lost, id_col, text_col, part_col)
    cells = scratch.save(mask_cells(masks, len(filters)), "cells")
    return interactions(cells, "".join(filters) + repeats, lost)


#: The same rows from DuckDB.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
        (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN coalesce(first < w.doc_id, false) THEN 16 ELSE 0 END) AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, good, bad, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, filter, 1 << (instr('ABCDE', filter) - 1) AS bit,
        coalesce(bit_or(1 << (instr('ABCDE', filter) - 1)) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM (SELECT filter_order, step, substr(filter_order, step, 1) AS filter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))),
r AS (SELECT part, filter_order, step, filter,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND bad = 1 THEN n ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
