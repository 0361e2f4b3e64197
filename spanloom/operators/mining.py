"""Hard negatives and corpus comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import ratio
from .dedup import deduplicate_negatives
from .dictionary import small
from .leakage import exclude
from .scratch import Scratch

MINE_FROM = 0.85


def hard_negatives(docs: DataFrame, preds: DataFrame, gold: DataFrame, protected: DataFrame, mine_from: float = MINE_FROM, key: str = "doc_id") -> DataFrame:
    """Confident predictions in unprotected documents without annotations, once for each text and term.

    The constant confidence that stands in for a missing one is high enough to count.
    """
    scratch = Scratch(docs.sparkSession, "negatives")
    free = exclude(docs, protected, T.lower_strip("text")).select(key, F.sha2(T.strip("text"), 256).alias("_sha"))
    own = scratch.save(free.join(gold.select(key).distinct(), key, "left_anti"), "own")
    hits = preds.where((F.col("confidence") >= mine_from) & ~T.is_blank("term")).join(own, key)
    rows = hits.select(key, "_sha", F.col("term").alias("false_positive_term"), F.col("category").alias("false_positive_category"), "confidence", F.lit(0).alias("gold_entity_count"), F.struct(key, "start").alias("_order"))
    first = scratch.save(deduplicate_negatives(rows, "_order", text="_sha").drop("_order", "_sha"), "first")
    texts = docs.join(small(first.select(key).distinct()), key, "left_semi").select(key, "text")  # texts join only the rows that stay
    return first.join(texts, key).select(key, "text", "false_positive_term", "false_positive_category", "confidence", "gold_entity_count")


def top_terms(negatives: DataFrame, n: int = 20, order: str = "doc_id") -> DataFrame:
    """The n most frequent false-positive terms, ties by first document, then term (a top-n report)."""
    t = negatives.groupBy(F.lower("false_positive_term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return t.orderBy(F.desc("n"), "first", "term").limit(n)


def vocabulary(texts: DataFrame, text: str = "text", n: int = 1) -> DataFrame:
    """Distinct words or n-grams of a corpus; n-grams don't cross texts."""
    grams = T.words(text) if n == 1 else T.ngrams(T.words(text), n)
    return texts.select(F.explode(grams).alias("g")).distinct()


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, shared, Jaccard, and the share of b that a covers."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), a.columns[0], "full")
    s = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    return s.select("*", ratio("shared", F.col("n_a") + F.col("n_b") - F.col("shared")).alias("jaccard"), ratio("shared", "n_b").alias("covered"))


def corpus_overlap(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Vocabulary and trigram overlap of two corpora, and their mean number of words."""
    out = None
    for n, name in ((1, "vocabulary"), (3, "trigrams")):
        row = set_overlap(vocabulary(a, text, n), vocabulary(b, text, n)).withColumn("unit", F.lit(name))
        out = row if out is None else out.unionByName(row)
    mean = lambda df, c: df.agg(F.avg(F.size(T.words(text))).alias(c)).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(mean(a, "mean_a"), "_one").join(mean(b, "mean_b"), "_one").drop("_one")
