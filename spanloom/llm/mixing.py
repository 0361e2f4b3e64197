"""Mixing sources to target weights by fixed-length blocks (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, quoted, text_of, unused

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST_TIMES = 3
#: Words of a block.
BLOCK_WORDS = 512
#: Slots of an output shard.
SHARD_SLOTS = 4096
ROUNDS = 12
#: Tables with a few rows for each source are broadcast up to so many sources, and joined by shuffle beyond.
MAX_BROADCAST_SOURCES = 50_000
#: Slots that one task unfolds, about, and such tasks at most (beyond, a task has more slots).
TASK_SLOTS, MOST_TASKS = 4 * SHARD_SLOTS, 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, s, source_size, target) from (source, source_size).

    Targets share the sum of all sizes by weight; what a source's limit leaves over is shared again by weight among the
    others until none is above its limit. That ends where every source has min(limit, weight * level) for one level:
    in the order of limit / weight, the sources before the first that stays below its limit are full. Sources are
    ordered by code point, null last. The table has a row for each source, not for each document.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("s", F.row_number().over(order) - 1).withColumn("w", weight).withColumn("cap", F.col("source_size") * most_times)
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("left_w"))
    t = t.withColumn("level", F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("a"), F.col("s"), F.col("level")))).over(every)["level"])
    return t.select("source", "s", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double"))).alias("target"))


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of i in a pseudorandom permutation of 0 .. n - 1 (swap-or-not shuffle, a bijection for every n)."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r, n), n) - x, n)
        return F.when(F.xxhash64(key, r, n, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, swap)


class Mix:
    """The plan of a mix and its use on the documents.

    Words of each source, document after document, form one stream, cut into blocks of block_words words (the last may be
    shorter). The output is a row of shards of shard_slots slots, each slot a block. For each shard, the number of slots
    that each source fills is drawn from a multinomial; a source's slots count on over the shards; slot q stands in
    pass q div blocks over the source, and a pseudorandom permutation of that pass gives its block. Draws beyond a source's
    share are void and a closing shard holds what was drawn too rarely, so a source's words end at its target, to a word.
    No pass starts beyond most_times, so no document is taken more often.

    Nulls: a null source is a source by itself; a null text has no words. A document without words is in no block and
    has taken 0. Ids need not be unique: rows are told apart by place, and ties of equal rows fall in any order without
    changing any column but which of the twins is which. Empty input gives empty output.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> None:
        self.names = (id_col, text_col, source_col)
        self.docs, self.block_words, self.shard_slots, self.seed = docs, block_words, shard_slots, seed
        self.scratch = Scratch(docs.sparkSession, "mixing")
        text = text_of(quoted(text_col))
        self.sizes = self.scratch.save(docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("hash"), F.col(quoted(source_col)).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
        self.rows = self.sizes.count()
        per_source = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        t = source_targets(per_source, weights, most_times)
        t = t.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most_times))
        t = t.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("whole", F.floor(F.col("source_size") / block_words))
        t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)))
        t = t.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil((F.col("quota") - F.col("passes") * F.col("source_size")) / block_words))
        self.sources = self.scratch.save(t, "sources")
        self.n_sources = max(1, self.sources.count())
        few = self.n_sources <= MAX_BROADCAST_SOURCES
        self.side = F.broadcast if few else lambda df: df

    def plan(self) -> DataFrame:
        """(shard, slot, s, pass, block, take): the block in each slot and how many of its words the mix takes."""
        src = self.side(self.sources)
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
        shards = math.ceil(total / self.shard_slots)
        # A multinomial draw: each slot falls in a source's share of [0, total). The range is cut into even bins, four for each
        # source, and a bin lists the shares that reach into it (1.25 on average), so a slot is compared with those only.
        upto = self.sources.where("slots > 0").withColumn("hi", F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("s"))).withColumn("lo", F.col("hi") - F.col("slots"))
        width = max(1, total // (4 * self.n_sources))
        guide = upto.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin"))
        slot = self.docs.sparkSession.range(total).withColumn("shard", F.floor(F.col("id") / self.shard_slots))
        ball = slot.withColumn("u", F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(max(1, total)))).withColumn("bin", F.floor(F.col("u") / width))
        drawn = ball.join(self.side(guide), "bin").where("lo <= u and u < hi").select("shard", "s")
        counts = drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = counts.withColumn("q0", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(src.select("s", "slots"), "s")
        runs = runs.withColumn("n", F.least("n", F.col("slots") - F.col("q0"))).where("n > 0").select("shard", "s", "q0", "n")
        rest = counts.groupBy("s").agg(F.sum("n").alias("drawn"))
        rest = src.join(rest, "s", "left").withColumn("q0", F.coalesce("drawn", F.lit(0))).where(F.col("q0") < F.col("slots"))
        closing = rest.select(F.lit(shards).cast("long").alias("shard"), "s", "q0", (F.col("slots") - F.col("q0")).alias("n"))
        # The closing shard's runs grow with the square root of the slots; they are cut so that no row unfolds to more than a shard.
        cut = runs.unionByName(closing).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / self.shard_slots))))
        cut = cut.withColumn("q0", F.col("q0") + F.col("part") * self.shard_slots).withColumn("n", F.least(F.col("n") - F.col("part") * self.shard_slots, F.lit(self.shard_slots)))
        tasks = int(min(MOST_TASKS, total // TASK_SLOTS + 1))
        q = cut.repartition(tasks, "shard", "s", "part").select("shard", "s", F.explode(F.sequence(F.col("q0"), F.col("q0") + F.col("n") - 1)).alias("q"))
        q = q.join(src.select("s", "source_size", "quota", "blocks", "whole"), "s")
        q = q.withColumn("pass", F.floor(F.col("q") / F.col("blocks"))).withColumn("i", F.col("q") % F.col("blocks"))
        block = F.when(F.col("i") < F.col("whole"), permuted(F.col("i"), F.col("whole"), F.xxhash64(F.lit(self.seed), F.col("s"), F.col("pass")))).otherwise(F.col("i"))
        left = F.col("quota") - (F.col("pass") * F.col("source_size") + F.col("i") * self.block_words)
        length = F.least(F.lit(self.block_words), F.col("source_size") - F.col("block") * self.block_words)
        q = q.withColumn("block", block).withColumn("take", F.least(length, left))
        return q.select("shard", "q", "s", "pass", "block", "take", length.alias("length"))

    def places(self) -> DataFrame:
        """(row, id, hash, s, size, start): where each document starts in its source's stream.

        Prefix sums in two levels: chunks by a hash of the id, and rows within a chunk. There are about as many chunks as
        rows in a chunk, so a source with a third of all rows is still cut into many even parts.
        """
        chunks = max(1, math.isqrt(self.rows))
        src = self.side(self.sources.select("source", "s", "source_size", "target"))
        d = self.sizes.withColumnRenamed("source", "_source").join(src, F.col("_source").eqNullSafe(F.col("source")))
        d = d.withColumn("chunk", F.pmod(F.xxhash64("id", "hash"), F.lit(chunks))).drop("_source")
        within = Window.partitionBy("s", "chunk").orderBy("id", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        sums = d.groupBy("s", "chunk").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        d = d.join(sums, ["s", "chunk"]).withColumn("start", F.col("start") + F.col("base"))
        return d.select("id", "hash", "source", "s", "source_size", "target", "size", "start")

    def pieces(self) -> tuple[DataFrame, DataFrame]:
        """Documents with their place, and their parts in the blocks: (s, start, pass, first, words).

        A document is known by (s, start) if it has words: no two such documents start at one place.
        """
        placed = self.scratch.save(self.places(), "places")
        b = self.block_words
        parts = placed.where("size > 0").select("s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        parts = parts.withColumn("from", F.greatest(F.col("start") - F.col("block") * b, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b)))
        joined = parts.join(self.plan(), ["s", "block"]).withColumn("words", F.least("to", "take") - F.col("from")).where("words > 0")
        return placed, joined.select("s", "start", "pass", (F.col("block") * b + F.col("from") - F.col("start")).alias("first"), "words")

    def taken(self) -> DataFrame:
        """(id, size, source, source_size, target, taken) for every document."""
        placed, parts = self.pieces()
        words = parts.groupBy("s", "start").agg(F.sum("words").alias("taken"))
        full = placed.where("size > 0").join(words, ["s", "start"], "left")
        every = full.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
        return every.select("id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents with the columns of the input: a row for each pass that takes words of a document.

        The text holds the words taken in that pass, in their order, with the white space before each of them; it is the
        text unchanged if all are taken. A column n_chars of whole numbers is set to the text's new length. Of rows
        that agree in id, source and text, the other columns are those of one of them.
        """
        id_col, text_col, source_col = (F.col(quoted(c)) for c in self.names)
        placed, parts = self.pieces()
        taken = parts.groupBy("s", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
        plan = placed.where("size > 0").select("id", "hash", "s", "start", "size", "source").join(taken, ["s", "start"]).select("id", "hash", "size", "source", "parts")
        plan = self.scratch.save(plan, "taken")
        several = self.sizes.groupBy("id", "hash", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "hash", "source")
        several = self.scratch.save(several, "twins")
        few = several.count()
        own, listed, *mine = unused(self.docs, "_hash", "_list", "_id", "_plan_hash", "_size", "_source", "_parts")
        plan = plan.toDF(*mine)
        several = several.toDF(mine[0], mine[1], mine[3])
        several = F.broadcast(several) if few <= MAX_BROADCAST_SOURCES else several
        rows = self.docs.withColumn(own, F.xxhash64(text_of(quoted(self.names[1]))))
        same = id_col.eqNullSafe(F.col(mine[0])) & (F.col(own) == F.col(mine[1])) & source_col.eqNullSafe(F.col(mine[3]))
        if few:
            rows = rows.join(several, same, "left_anti").unionByName(rows.join(several, same, "left_semi").dropDuplicates([self.names[0], own, self.names[2]]))
        mixed = rows.join(plan, same)
        words = F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
        part = F.transform(mine[4], lambda p: F.array_join(F.slice(listed, (p["first"] + 1).cast("int"), p["words"].cast("int")), ""))
        cut = F.when(F.aggregate(mine[4], F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col(mine[2]), text_col).otherwise(F.regexp_replace(F.array_join(part, ""), r"^[\x20\x09-\x0D]+", ""))
        mixed = mixed.withColumn(listed, words).withColumn(self.names[1], cut)
        whole = lambda c: c == "n_chars" and self.docs.schema[c].dataType.typeName() in ("long", "integer")
        return mixed.select(*[F.length(text_col).cast(self.docs.schema[c].dataType).alias(c) if whole(c) else F.col(quoted(c)) for c in self.docs.columns])
