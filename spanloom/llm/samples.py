"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, text_of

STEPS = 1 << 30


def _thinned(rows: DataFrame, part: dict[int, float], hash_: Column, rank: list[Column]) -> DataFrame:
    """About part[y] of the rows of each class y, by a hash of the id, and always its first by rank."""
    first = rows.groupBy("y").agg(F.min(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rank)])).alias("r")).collect()  # a row for each class
    keep = F.lit(False)
    for y, r in first:
        least = functools.reduce(Column.__and__, [c == F.lit(v) for c, v in zip(rank, r, strict=True)])
        keep = keep | ((F.col("y") == y) & ((F.pmod(hash_, F.lit(STEPS)) < part[y] * STEPS) | least))
    return rows.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, per_class: int, most_chars: int, keep: list[Column], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, share, text, keep): whole texts with a label 0 or 1, marked by learn (a condition on id_col).

    Each class has about per_class documents at most, and about most_chars / 2 characters; both bounds thin the rows by a hash of
    the id, so the sample is the same on every run, and of each class at least one row stays (by the second bound its shortest). share is
    the part of its class that was taken. Rows with a null label or id are left out; of several labels of one id the largest counts.
    """
    y = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y")).withColumnRenamed("id", id_col).where(learn).withColumnRenamed(id_col, "id")
    sizes = {r.y: r.n for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    part = {k: min(1.0, per_class / max(1, n)) for k, n in sizes.items()}
    few = _thinned(y, part, F.xxhash64("id"), [F.xxhash64("id")])
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), text_of(quoted(text_col)).alias("text"), *keep).join(F.broadcast(few), F.col("_id") == F.col("id")).drop("_id")
    rows = scratch.save(rows.withColumn("size", F.length("text")), "sample")
    chars = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("size").alias("n")).collect()}
    less = {k: min(1.0, most_chars / 2 / max(1, n)) for k, n in chars.items()}
    rows = _thinned(rows, less, F.xxhash64("id", F.lit(1)), [F.col("size"), F.xxhash64("id")])
    share = F.lit(1.0)
    for k, p in part.items():
        share = F.when(F.col("y") == k, F.lit(p * less.get(k, 1.0))).otherwise(share)
    return rows.withColumn("share", share).drop("id", "size")
