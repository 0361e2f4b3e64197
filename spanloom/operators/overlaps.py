"""Joins of spans by place, within long documents too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused

#: Characters in a bin: far more than in most spans, far fewer than in a long document.
BIN = 512


def places(start: str, end: str) -> Column:
    """The numbers of the bins that a span touches; null for a span without characters or with a null offset."""
    at = lambda c: F.floor(c / F.lit(BIN))
    return F.when(F.col(start) < F.col(end), F.sequence(at(F.col(start)), at(F.col(end) - 1)))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id", how: str = "left") -> DataFrame:
    """left with all spans of right (columns named r_*) that share a character with it, within a document; how is left or inner.

    Spans meet in the bins of BIN characters that they touch, so a long document is many small joins and not one product; a pair
    counts in the bin where the later of both begins. A span without characters or with a null offset meets nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how!r}")
    at, place = unused(left, "_at", "_place")
    spread = F.posexplode_outer(places("start", "end")) if how == "left" else F.posexplode(places("start", "end"))
    l = left.select("*", spread.alias(at, place))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(places("start", "end")).alias("_r_place"))
    same = (l[key] == r[f"r_{key}"]) & (l[place] == r["_r_place"]) & (l[place] == F.floor(F.greatest(l["start"], r["r_start"]) / F.lit(BIN)))
    met = l.join(r, same & (F.greatest(l["start"], r["r_start"]) < F.least(l["end"], r["r_end"])), how)
    if how == "left":  # a span without a partner in one of its bins may have one in another; one that has none stays once
        alone = F.col("_r_place").isNull()
        some = F.bool_or(~alone).over(Window.partitionBy(key, "start", "end"))
        met = met.withColumn("_some", some).where(~alone | (~F.col("_some") & (F.coalesce(F.col(at), F.lit(0)) == 0))).drop("_some")
    return met.drop(at, place, "_r_place")
