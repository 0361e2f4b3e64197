"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b) of two longs: comp is the smallest node reachable.

    Rows with a null end and loops are ignored; repeated edges are one. Each round ties every node to the smallest of its
    neighbours, first among larger then among smaller ones, until nothing changes (about log of the largest
    component's size, few for stars). Minima are combined before the shuffle and written, so that the join with a hub's
    many edges can be split by the planner. An edge table stays in the shared folder after each round.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = scratch.save(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(tied.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _digest(new)
        scratch.drop(e, least, large, small_least)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
