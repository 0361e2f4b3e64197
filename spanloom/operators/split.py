"""Splits and folds that keep related records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .components import connected_components
from .dedup import deduplicate_normalised, deduplicate_records
from .dictionary import aligned_records, small
from .leakage import exclude, protected_texts
from .names import unused
from .scratch import Scratch
from .similarity import ratio_pairs


def sentence_edges(records: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges (a, b) from each record to the least record that holds one of its sentences: a star for each shared sentence."""
    s = records.select(key, F.explode(F.array_distinct(T.sentences(text))).alias("s"))
    hub = s.groupBy("s").agg(F.min(key).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return s.join(hub.drop("n"), "s").where(F.col(key) != F.col("hub")).select(F.col("hub").alias("a"), F.col(key).alias("b")).distinct()


def sentence_components(records: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): records connected by shared sentences; component is the least key."""
    c = connected_components(sentence_edges(records, key, text), scratch)
    return records.select(key).join(c.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("comp", key).alias("component"))


def component_split(records: DataFrame, scratch: Scratch, order: str, train: float = 0.70, dev: float = 0.15, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component, split) of the deduplicated records: whole components are dealt to train, dev and test.

    Components come in a seeded order (by MD5 of seed and component) and fill train while they fit its share, then dev, then test; train also takes one when dev is
    full and train is short. The order is cut into about as many chunks as a chunk has components, and a chunk
    is a row of a table of sums. A chunk that fits as a whole, or of which nothing fits, is dealt as a whole; only the components of the few
    chunks where a limit is reached are looked at one by one.
    """
    own = deduplicate_records(records, order, text)
    comp = scratch.save(sentence_components(own, scratch, key, text), "components")
    n = comp.count()
    most = (int(n * train), int(n * dev))
    order_of = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("component").cast("string")).cast("binary"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("o", order_of)
    digits = max(0, round(math.log(max(1, sizes.count()), 256)))
    sizes = scratch.save(sizes.withColumn("chunk", F.substring("o", 1, digits)), "sizes")
    chunks = sizes.groupBy("chunk").agg(F.sum("n").alias("total"), F.min("n").alias("least")).orderBy("chunk").collect()  # about the square root of the components
    have, whole, single = [0, 0], [], []
    for c in chunks:
        left = [m - h for m, h in zip(most, have, strict=True)]
        takes_any = left[1] <= 0 < left[0]  # dev is full and train is short: train takes whatever comes
        if not takes_any and c.total <= left[0]:
            whole.append((c.chunk, "train"))
            have[0] += c.total
        elif not takes_any and c.least > left[0] and c.total <= left[1] and not (c.total == left[1] and left[0] > 0):
            whole.append((c.chunk, "dev"))
            have[1] += c.total
        elif not takes_any and c.least > left[0] and c.least > left[1]:
            whole.append((c.chunk, "test"))
        else:
            for r in sizes.where(F.col("chunk") == c.chunk).orderBy("o", "component").select("component", "n").collect():  # one chunk
                if have[0] + r.n <= most[0] or (have[1] >= most[1] and have[0] < most[0]):
                    have[0] += r.n
                    single.append((r.component, "train"))
                elif have[1] + r.n <= most[1]:
                    have[1] += r.n
                    single.append((r.component, "dev"))
                else:
                    single.append((r.component, "test"))
    spark, kind = comp.sparkSession, comp.schema["component"].dataType.simpleString()
    by_chunk = F.broadcast(spark.createDataFrame(whole, "chunk string, by_chunk string"))
    by_one = F.broadcast(spark.createDataFrame(single, f"component {kind}, by_one string"))
    dealt = sizes.join(by_chunk, "chunk", "left").join(by_one, "component", "left").select("component", F.coalesce("by_one", "by_chunk").alias("split"))
    return comp.join(dealt, "component").select(key, "component", "split")


def stratified_folds(records: DataFrame, stratum: str, k: int = 5, key: str = "doc_id", seed: int | None = None) -> DataFrame:
    """records with a fold from 0 to k - 1, dealt in turn within each stratum, by key or by a seeded hash of it.

    Rows are numbered in two levels, within chunks of a stratum by key range or hash and over the chunks' sizes, so no stratum is sorted in one task.
    """
    o = F.col(key) if seed is None else F.xxhash64(F.lit(seed), F.col(key))
    rows = records.withColumn("_o", o)
    bounds = rows.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not bounds.n:
        return records.withColumn("fold", F.lit(0))
    chunks = max(1, round(bounds.n**0.5))
    width = max(1, (bounds.hi - bounds.lo) // chunks + 1)
    rows = rows.withColumn("_chunk", F.floor((F.col("_o").cast("decimal(38,0)") - F.lit(bounds.lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long"))
    sizes = rows.groupBy(stratum, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(stratum).alias("_s"), F.col("_chunk").alias("_c"), "_before")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum, "_chunk").orderBy("_o", key)) - 1)
    rows = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return rows.withColumn("fold", ((F.col("_rank") + F.col("_before")) % k).cast("int")).drop("_o", "_chunk", "_s", "_c", "_before", "_rank")


def seeded_sample(records: DataFrame, stratum: str, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n records of each stratum, the least by MD5 of seed and key (a sampling operator); candidates are cut before the shuffle."""
    hashed, rows, mine, rank = unused(records, "_h", "_n", "_s", "_k")
    near = records.withColumn(hashed, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    top = small(near.groupBy(stratum).agg(F.count(F.lit(1)).alias(rows)).withColumnRenamed(stratum, mine))
    # a hash bound that leaves about 4 n + 64 rows of a stratum, then the exact choice among them
    share = F.least(F.lit(1.0), (4 * n + 64) / F.col(rows))
    few = near.join(top, F.col(stratum).eqNullSafe(F.col(mine))).where(F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") / F.lit(2.0**48) <= share)
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(stratum).orderBy(hashed, key))).where(F.col(rank) <= n).select(*records.columns)


def like_paraphrases(real: DataFrame, paraphrases: DataFrame, scratch: Scratch, least: float = 0.7, key: str = "doc_id") -> DataFrame:
    """(para_id, val_id): paraphrases and the records they are like by sequence ratio. All folds are cut from this one table, since each record is validated in one of them."""
    pairs = ratio_pairs(paraphrases.select("para_id", "text"), real.select(F.col(key).alias("val_id"), "text"), least, "para_id", "val_id")
    return scratch.save(pairs.select("para_id", "val_id"), "alike")


def fold_pools(real: DataFrame, folds: DataFrame, fold: int, paraphrases: DataFrame, generated: DataFrame, alike: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool, removed, validation) parts of one fold: training pools by name, and the paraphrases removed with their reason; alike: like_paraphrases.

    A paraphrase goes if its source is a validation text (reason source), else if it is like one by sequence ratio (similarity), with all
    paraphrases of the same source_id. Generated texts equal to a validation text go.
    """
    tagged = real.join(folds.select(key, "fold"), key)
    val, train = tagged.where(F.col("fold") == fold), tagged.where(F.col("fold") != fold)
    by_source = paraphrases.join(val.select(T.normalise("text").alias("_k")).distinct(), T.normalise("source_text") == F.col("_k"), "left_semi").select("source_id").distinct()
    rest = paraphrases.join(by_source, "source_id", "left_anti")
    near = alike.join(val.select(F.col(key).alias("val_id")), "val_id", "left_semi").select("para_id").distinct()
    by_similarity = rest.join(near, "para_id", "left_semi").select("source_id").distinct()
    kept = rest.join(by_similarity, "source_id", "left_anti")
    removed = by_source.withColumn("reason", F.lit("source")).unionByName(by_similarity.withColumn("reason", F.lit("similarity")))
    clean = exclude(generated, protected_texts([val]), T.lower_strip("text"))
    pool = train.select("text").withColumn("pool", F.lit("real")).unionByName(kept.select("text").withColumn("pool", F.lit("paraphrase"))).unionByName(clean.select("text").withColumn("pool", F.lit("generated")))
    return pool, removed, val


def make_folds(records: DataFrame, classes: Column, paraphrases: DataFrame, generated: DataFrame, order: str = "doc_id", k: int = 5, least: float = 0.7, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, pools, counts) of cross-validation: near-exact copies go, records are dealt to k folds within their classes, and each fold gets its pools.

    folds: (key, fold); pools: (fold, pool, text); counts: (fold, part, n) of the pools, the validation texts and the sources removed, by reason.
    """
    scratch = Scratch(records.sparkSession, "folds")
    real = scratch.save(deduplicate_normalised(records, order).withColumn("_class", classes), "records")
    folds = scratch.save(stratified_folds(real.select(key, "_class"), "_class", k, key).select(key, "fold"), "folds")
    alike = like_paraphrases(real.select(key, "text"), paraphrases, scratch, least, key)
    pools = counts = None
    for fold in range(k):
        pool, removed, val = fold_pools(real.select(key, "text"), folds, fold, paraphrases, generated, alike, key)
        parts = pool.groupBy(F.col("pool").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        parts = parts.unionByName(removed.groupBy(F.concat(F.lit("removed_by_"), "reason").alias("part")).agg(F.count(F.lit(1)).alias("n")))
        parts = parts.unionByName(val.agg(F.count(F.lit(1)).alias("n")).select(F.lit("validation").alias("part"), "n"))
        own, parts = pool.select(F.lit(fold).alias("fold"), "pool", "text"), parts.select(F.lit(fold).alias("fold"), "part", "n")
        pools, counts = (own, parts) if pools is None else (pools.unionByName(own), counts.unionByName(parts))
    return folds, pools, counts


def prepare(records: DataFrame, spans: DataFrame, scratch: Scratch, order: str = "doc_id", seed: int = 42, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records with split, spans ready to be stored): deduplicated records in train, dev and test, whole components of shared sentences
    together, and their spans moved to token ends without overlaps."""
    split = component_split(records, scratch, order, seed=seed, key=key, text=text)
    own = scratch.save(records.join(split.select(key, "split"), key), "records")
    kept = spans.join(own.select(key, "split"), key).drop("split")
    return own, aligned_records(own, kept, key, text)
