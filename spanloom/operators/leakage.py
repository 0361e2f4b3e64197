"""Audits of what evaluation data share with training data."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.labels import ratio
from .dictionary import MAX_BROADCAST_TERMS, dictionary_entities, match_terms, small
from .names import quoted, unused


#: Items of one or two words are compared with every text up to this number.
MOST_SHORT = 1000


def tag_union(pools: dict[str, DataFrame], column: str = "augmentation_type") -> DataFrame:
    """All pools, one after the other, with their names."""
    out = None
    for name, df in pools.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def protected_texts(pools: list[DataFrame], text: str = "text") -> DataFrame:
    """Distinct lower-cased, stripped texts of all pools."""
    out = pools[0].select(T.lower_strip(text).alias("key"))
    for df in pools[1:]:
        out = out.unionByName(df.select(T.lower_strip(text).alias("key")))
    return out.distinct()


def exclude(rows: DataFrame, protected: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is not among the protected ones; a null key never is.

    Keys may be whole texts, so two 64-bit hashes of them meet, computed once for each row.
    """
    h, g, ph, pg = unused(rows, "_h", "_g", "_ph", "_pg")
    own = protected.where(F.col("key").isNotNull()).select(F.xxhash64("key").alias(ph), F.xxhash64(F.lit(1), "key").alias(pg)).distinct()
    keyed = rows.withColumns({h: F.when(key.isNotNull(), F.xxhash64(key)), g: F.xxhash64(F.lit(1), key)})
    return keyed.join(own, (F.col(h) == F.col(ph)) & (F.col(g) == F.col(pg)), "left_anti").select(*[quoted(c) for c in rows.columns])


def only_in(rows: DataFrame, base: DataFrame, text: str = "text") -> DataFrame:
    """Rows (repeated ones too) whose normalised text is not in base."""
    return exclude(rows, base.select(T.normalise(text).alias("key")), T.normalise(text))


def split_overlap(records: DataFrame, split: str, units: Column) -> DataFrame:
    """(a, b, n_shared) for each pair of splits that share a unit; units: an array per record (its text, or its sentences)."""
    u = records.select(F.col(split).alias("s"), F.explode(units).alias("u")).distinct().groupBy("u").agg(F.array_sort(F.collect_set("s")).alias("ss")).where("size(ss) > 1")
    pairs = F.flatten(F.transform("ss", lambda a: F.transform(F.filter("ss", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return u.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_shared"))


def terms_in_texts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, term as listed) where a term stands in a text between word ends, in any case."""
    hits = match_terms(docs, terms, key, text).select(key, "ord").distinct()
    return hits.join(small(terms.select("ord", "term")), "ord").select(key, "term")


def contained_items(docs: DataFrame, items: DataFrame, item_key: str, key: str = "doc_id", text: str = "text", gram: int = 4) -> DataFrame:
    """(key, item_key) where the item's text is part of the document's.

    An item's second to fifth word stand whole in any text that holds it, so texts and items meet on these words by
    an equi-join, and only pairs that meet are compared. Items with fewer than three words are compared with every text if they are few; if there are
    more than MOST_SHORT, they meet the texts on their first characters.
    """
    cut = lambda x: F.filter(F.split(x, T.SPACE + "+"), lambda w: w != "")
    i = items.select(item_key, F.col(text).alias("_item"), cut(F.col(text)).alias("_w")).where(~T.is_blank("_item"))
    i = i.withColumn("_n", F.least(F.lit(gram), F.size("_w") - 2)).withColumn("_g", F.when(F.col("_n") > 0, F.array_join(F.slice("_w", 2, F.greatest("_n", F.lit(1))), " ")))
    long, short = i.where("_n > 0").select(item_key, "_g"), i.where("_n <= 0").select(item_key, "_item")
    sizes = F.array(*[F.lit(n) for n in range(1, gram + 1)])
    grams = F.transform(F.array(cut(F.col(text))), lambda w: F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))).otherwise(F.array().cast("array<string>"))))))[0]
    named = small(long.select(F.col("_g").alias("_gram"), item_key))
    met = docs.select(key, F.explode(grams).alias("_gram")).join(named, "_gram").select(key, item_key).distinct()
    pairs = met.join(docs.select(key, text), key).join(i.select(item_key, "_item"), item_key).where(F.contains(F.col(text), F.col("_item"))).select(key, item_key)
    short = short.withColumn("_n", F.least(F.lit(gram), F.length("_item"))).withColumn("_gram", F.substring("_item", F.lit(1), F.col("_n")))
    if short.limit(MOST_SHORT + 1).count() <= MOST_SHORT:
        met = docs.select(key, text).join(F.broadcast(short), F.contains(F.col(text), F.col("_item")))
    else:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        grams = F.flatten(F.transform(sizes, lambda n: F.transform(starts, lambda k: F.substring(F.col(text), k, n))))
        met = docs.select(key, F.explode(F.array_distinct(grams)).alias("_gram")).join(small(short.select("_gram", "_item", item_key)), "_gram")
        met = met.join(docs.select(key, text), key).where(F.contains(F.col(text), F.col("_item")))
    return pairs.unionByName(met.select(key, item_key)).distinct()


def word_jaccard_pairs(left: DataFrame, right: DataFrame, least: float, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """(left_key, right_key, jaccard) of texts whose word sets are alike by least or more.

    Words are ordered by how many texts of right hold them, rare ones first. Two sets that are alike enough share a word among the first
    n - ceil(least * n) + 1 of each (n its size), so an equi-join on these words finds every pair. While right has at most MAX_BROADCAST_TERMS distinct words,
    they are sent to the texts of left, and of these only the ones with such a word leave their place.
    """
    return jaccard_texts(left, right, least, left_key, right_key, text).select(left_key, right_key, "jaccard")


def jaccard_texts(left: DataFrame, right: DataFrame, least: float, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """word_jaccard_pairs with both texts, as _left and _right."""
    r = right.select(right_key, F.col(text).alias("_right"), T.word_set(text).alias("rw")).where("size(rw) > 0")
    l = left.select(left_key, F.col(text).alias("_left"), T.word_set(text).alias("lw")).where("size(lw) > 0")  # noqa: E741
    df = r.select(F.explode("rw").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    own_key = [right_key, "_right", "rw"]

    def prefix(rows: DataFrame, key: list[str], words: str) -> DataFrame:
        n = rows.select(*key, F.size(words).alias("n"), F.explode(words).alias("w")).join(df, "w", "left")
        first = n.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("ws"))
        return first.select(*key, F.explode(F.slice("ws", 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))["w"]).alias("w"))

    few = df.orderBy("df", "w").limit(MAX_BROADCAST_TERMS + 1)
    ranked = [x.w for x in few.collect()]  # at most MAX_BROADCAST_TERMS + 1 words
    firsts = prefix(r, own_key, "rw")
    if len(ranked) <= MAX_BROADCAST_TERMS:
        met = _with_prefix(l, ranked, least).join(small(firsts), "w").drop("w")
    else:
        met = prefix(l, [left_key], "lw").join(firsts, "w").drop("w").join(l, left_key)
    shared = F.size(F.array_intersect("lw", "rw"))
    both = met.withColumn("jaccard", shared / (F.size("lw") + F.size("rw") - shared)).where(F.col("jaccard") >= least)
    return both.select(left_key, right_key, "_left", "_right", "jaccard").distinct()


def _with_prefix(rows: DataFrame, ranked: list[str], least: float) -> DataFrame:
    """rows (with lw, a set of words) once for each word w that stands in their prefix and in ranked; words not in ranked come first, then those in its order."""
    sent = rows.sparkSession.sparkContext.broadcast(ranked)

    def run(batches):
        vocabulary = pa.array(sent.value, pa.string())
        for batch in batches:
            sets = batch.column("lw")
            n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(n)), n)
            rank = pc.fill_null(pc.index_in(sets.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((rank, of))
            rank = rank[order]
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(n * least).astype(np.int64) + 1
            own = np.flatnonzero((place < most[of]) & (rank >= 0))
            if len(own):
                out = batch.take(pa.array(of[own]))
                yield pa.RecordBatch.from_arrays([*out.columns, vocabulary.take(pa.array(rank[own]))], names=[*out.schema.names, "w"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("w", "string"))


def covered_terms(terms: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Terms that equal an annotated surface, case aside."""
    return terms.join(surfaces.select(F.lower("term").alias("_t")).distinct(), F.lower("term") == F.col("_t"), "left_semi")


def matched_in_context(gold: DataFrame, docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gold spans (key, start, end, label, term) that the dictionary finds with the same offsets, label and surface."""
    d = dictionary_entities(docs, terms, key).select(key, "start", "end", F.col("category").alias("label"), "term")
    return gold.join(d, [key, "start", "end", "label", "term"], "left_semi")


def audit(checks: dict[str, DataFrame], informational: tuple[str, ...] = (), samples: int = 5) -> DataFrame:
    """(check, passed, n, sample): a check passes if its table of findings is empty; informational ones always do. sample: the first few findings as JSON, in order."""
    out = None
    for name, found in checks.items():
        rows = found.select(F.to_json(F.struct(*found.columns)).alias("j"))
        first = rows.orderBy("j").limit(samples).agg(F.collect_list("j").alias("sample"))
        one = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one")
        part = one.select(F.lit(name).alias("check"), (F.lit(name in informational) | (F.col("n") == 0)).alias("passed"), "n", F.array_sort("sample").alias("sample"))
        out = part if out is None else out.unionByName(part)
    return out


def shared_units(records: DataFrame, split: str, a: str, b: str, units: Column) -> DataFrame:
    """(unit): distinct units (an array per record) of split a that split b has too."""
    own = lambda s: records.where(F.col(split) == s).select(F.explode(units).alias("unit")).distinct()
    return own(a).join(own(b), "unit", "left_semi")


def leakage_checks(records: DataFrame, split: str, benchmark: DataFrame, terms: DataFrame, gold: DataFrame, holdout: DataFrame, known: DataFrame, generated: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> dict[str, DataFrame]:
    """The findings of seven checks by name, for audit().

    records: (key, text, split) in train, dev and test. benchmark: (item_key, text, term), protected texts with their terms. gold: (key, start, end, label, term), the annotations of records.
    holdout, known and generated: tables with a text.
    1 texts and 2 sentences that two splits share; 3 benchmark terms that are dictionary terms; 4 those that are annotated surfaces;
    5 those that the dictionary finds in the benchmark's own texts; 6 holdout sentences that the known pool has; 7 benchmark terms in generated texts.
    """
    pairs = (("train", "dev"), ("train", "test"), ("dev", "test"))
    whole = F.filter(F.array(T.strip(text)), lambda x: x != "")
    between = lambda units: functools.reduce(DataFrame.unionByName, [shared_units(records, split, a, b, units).withColumn("between", F.lit(f"{a} {b}")) for a, b in pairs])
    protected = benchmark.where("term is not null").select(F.col("term"), F.lit("").alias("label"), F.lit(1).alias("ord")).distinct()
    sentences = lambda df: df.select(F.explode(T.sentences(text)).alias("unit")).distinct()
    found = dictionary_entities(benchmark.select(item_key, text), terms, item_key, text).select(item_key, F.col("term").alias("_term"), "start")
    in_context = benchmark.join(found, item_key).where(F.lower("_term") == F.lower("term")).select(item_key, "term", "start")
    numbered = protected.select("term", "label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")).alias("ord"))  # a row for each protected term
    return {
        "shared_texts": between(whole),
        "shared_sentences": between(T.sentences(text)),
        "terms_in_dictionary": covered_terms(protected.select("term"), terms.select("term")),
        "terms_annotated": covered_terms(protected.select("term"), gold.select("term")),
        "terms_in_context": in_context,
        "holdout_in_known_pool": sentences(holdout).join(sentences(known), "unit", "left_semi"),
        "terms_in_generated": terms_in_texts(generated.select(F.xxhash64(text).alias("id"), text).distinct(), numbered, "id", text),
    }


def fold_checks(folds: DataFrame, fold_train: DataFrame, benchmark: DataFrame, test: DataFrame, surfaces: DataFrame, terms: DataFrame, canonical: DataFrame, text: str = "text") -> DataFrame:
    """(fold, check, passed, n) for every fold, and fold null for the check of the canonical terms against the dictionary.

    folds: (fold, text), validation texts; fold_train: (fold, text), the pools trained on; surfaces: (fold, term), annotated in training; benchmark: (text, term);
    test: (text), shared with validation by design, so that check only informs; canonical: (term).
    """
    val = folds.select("fold", T.lower_strip(text).alias("k")).distinct()
    keys = lambda df, *more: df.select(*more, T.lower_strip(text).alias("k")).distinct()
    own = benchmark.select(F.lower("term").alias("k")).where("k is not null").distinct()
    checks = {
        "validation_in_benchmark": (val.join(keys(benchmark), "k", "left_semi"), False),
        "validation_in_test": (val.join(keys(test), "k", "left_semi"), True),
        "validation_in_train": (val.join(keys(fold_train, "fold"), ["fold", "k"], "left_semi"), False),
        "terms_in_training": (surfaces.select("fold", F.lower("term").alias("k")).distinct().join(own, "k", "left_semi"), False),
    }
    numbers = folds.select("fold").distinct()
    out = canonical.select(F.lower("term").alias("k")).distinct().join(terms.select(F.lower("term").alias("k")).distinct(), "k", "left_semi")
    out = out.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast(numbers.schema["fold"].dataType).alias("fold"), F.lit("canonical_terms").alias("check"), (F.col("n") == 0).alias("passed"), "n")
    for name, (found, informs) in checks.items():
        n = numbers.join(found.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold", "left").na.fill(0, ["n"])
        out = out.unionByName(n.select("fold", F.lit(name).alias("check"), (F.lit(informs) | (F.col("n") == 0)).alias("passed"), "n"))
    return out


def near_duplicate_audit(augmented: DataFrame, real: DataFrame, evaluation: DataFrame, least: float = 0.7, text: str = "text") -> DataFrame:
    """One row: distinct synthetic texts (those of augmented that are not real), how many of them and how many real texts are like an
    evaluation text by sequence ratio, both shares, and whether no synthetic one is; the real share only informs."""
    from .similarity import ratio_pairs

    keyed = lambda df: df.select(T.normalise(text).alias("text")).distinct().withColumn("id", F.sha2("text", 256))
    right = keyed(evaluation).withColumnRenamed("id", "other")
    out = None
    for name, df in (("synthetic", keyed(only_in(augmented, real, text))), ("real", keyed(real))):
        like = ratio_pairs(df, right, least, "id", "other").select("id").distinct().agg(F.count(F.lit(1)).alias(f"{name}_like"))
        both = df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1)).join(like.withColumn("_one", F.lit(1)), "_one")
        out = both if out is None else out.join(both, "_one")
    return out.select("synthetic", "synthetic_like", "real", "real_like", ratio("synthetic_like", "synthetic").alias("synthetic_rate"), ratio("real_like", "real").alias("real_rate"), (F.col("synthetic_like") == 0).alias("passed"))
