"""Families of similar items, cut into blocks that are compared with one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a family that meet in one group of a comparison.
BLOCK = 256


def cells(families: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(family, cid, comp, inside, i, j, left, columns of items): blocks of each family's members to compare.

    families: (family, cid, comp); family is the component of its hub. Members outside the family's component are compared with those inside, and
    with each other. A family of any size is cut into blocks of about block members, and each pair of blocks is a
    group (family, inside, i, j) of at most two blocks, whose left rows are compared with its other rows (a
    block with itself has left rows only).
    """
    rows = families.withColumn("out", F.col("comp") != F.col("family"))
    size = rows.groupBy("family").agg(F.ceil(F.count_if("out") / block).alias("n_out"), F.ceil(F.count_if(~F.col("out")) / block).alias("n_in"))
    rows = rows.join(size, "family").where("n_out > 0").withColumn("block", F.pmod(F.xxhash64("cid"), F.when(F.col("out"), F.col("n_out")).otherwise(F.col("n_in"))))
    cell = lambda i, j, inside, left: F.struct(i.alias("i"), j.alias("j"), F.lit(inside).alias("inside"), left.alias("left"))
    b = F.col("block")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    against_in = F.when(F.col("n_in") > 0, F.transform(upto("n_in"), lambda k: cell(b, k, True, F.lit(True)))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,inside:boolean,left:boolean>>"))
    against_out = F.transform(upto("n_out"), lambda k: cell(F.least(b, k), F.greatest(b, k), False, b <= k))
    against = F.transform(upto("n_out"), lambda k: cell(k, b, True, F.lit(False)))
    rows = rows.select("family", "cid", "comp", F.explode(F.when(F.col("out"), F.concat(against_in, against_out)).otherwise(against)).alias("c"))
    return rows.select("family", "cid", "comp", "c.*").join(items, "cid")


KEYS = ["family", "inside", "i", "j"]


def open_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """members with family and comp, for the buckets whose members lie in several components.

    members: (key, cid, hub, ...) of buckets with more than two members; components: (node, comp). A bucket joins the family of its hub's component.
    """
    placed = members.join(components.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    keys = placed.groupBy("key").agg(F.max(F.when(F.col("cid") == F.col("hub"), F.col("comp"))).alias("family"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return placed.join(keys.where("lo <> hi").select("key", "family"), "key")
