"""First-wins deduplication of records and spans, conflicts, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .bloom import gone
from .names import quoted, unused
from .scratch import Scratch


#: Rows that go are named by broadcast up to this number; beyond, a Bloom filter of them keeps the other rows in place.
MAX_BROADCAST = 1_000_000


def key_hashes(keys: list[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key of several parts; a null part is unlike any value, and unlike a null at another place."""
    flat = [x for k in keys for x in (k, k.isNull())]
    return F.xxhash64(*flat), F.xxhash64(F.lit(1), *flat)


def _columns(keys: list[Column | str]) -> list[Column]:
    return [F.col(quoted(k)) if isinstance(k, str) else k for k in keys]


def first_by(df: DataFrame, keys: list[Column | str], order: str, limit: int = MAX_BROADCAST) -> DataFrame:
    """The row of least order for each key, with all columns; a null order comes last, and of rows that agree in key and order one stays.

    Only thin rows meet: two hashes of the key, the order and a row number. Minima are combined before the shuffle, so no key fills a
    task. The rows that are not least are then taken away where they are, so texts are not shuffled; a key is computed once for each of the two
    passes over df. Rows that agree in key and order with a least one are told apart by a grouping of just those.
    """
    scratch = Scratch(df.sparkSession, "first")
    h, g, o = unused(df, "_h", "_g", "_o")
    keyed = df.withColumns(dict(zip((h, g), key_hashes(_columns(keys)), strict=True))).withColumn(o, F.col(quoted(order)))
    thin = scratch.save(keyed.select(F.col(h).alias("h"), F.col(g).alias("g"), F.col(o).alias("o")).withColumn("rid", F.monotonically_increasing_id()), "thin")
    rank = F.struct(F.col("o").isNull().alias("none"), "o", "rid")
    least = thin.groupBy("h", "g").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lost = thin.join(least, ["h", "g"]).where("rid <> least.rid").groupBy("h", "g", "o").agg(F.bool_or(F.col("o").eqNullSafe(F.col("least.o"))).alias("_twin"))
    lost = scratch.save(lost, "lost")
    scratch.drop(thin)
    stay, out = gone(keyed, [h, g, o], lost, limit, scratch)
    own = [quoted(c) for c in df.columns]
    if lost.where("_twin").isEmpty():
        return stay.select(*own)
    return stay.unionByName(out.where("_twin").dropDuplicates([h, g]).drop("_twin")).select(*own)


def first_row(df: DataFrame, keys: list[Column | str], order: str) -> DataFrame:
    """As first_by, for derived tables of thin rows: one aggregate, combined before the shuffle, so df is computed once; of equal orders one row stays."""
    h, g = key_hashes(_columns(keys))
    whole = F.struct(*[F.col(quoted(c)) for c in df.columns])
    grouped = df.select(h.alias("_h"), g.alias("_g"), F.struct(F.col(quoted(order)).isNull().alias("none"), F.col(quoted(order)).alias("o")).alias("_rank"), whole.alias("_row")).groupBy("_h", "_g")
    return grouped.agg(F.min_by("_row", "_rank").alias("_row")).select("_row.*")


def deduplicate_records(records: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Rows with equal stripped texts (case counts) are one: the first, with its text untrimmed. Blank texts go."""
    return first_by(records.where(~T.is_blank(text)), [T.strip(text)], order)


def deduplicate_normalised(records: DataFrame, order: str, text: str = "text") -> DataFrame:
    """As before by lower case and single spaces; a blank text is a text."""
    return first_by(records, [T.normalise(text)], order)


def deduplicate_collapsed(records: DataFrame, order: str, text: str = "text") -> DataFrame:
    """By single spaces, case kept."""
    return first_by(records, [T.collapse(text)], order)


def deduplicate_accepted(records: DataFrame, accepted: Column, order: str, text: str = "text") -> DataFrame:
    """Accepted rows by lower-cased text; a rejected row blocks no later one."""
    return first_by(records.where(accepted), [T.lower_strip(text)], order)


def deduplicate_negatives(rows: DataFrame, order: str, text: str = "text", term: str = "false_positive_term") -> DataFrame:
    """By stripped text and lower-cased term."""
    return first_row(rows, [T.strip(text), F.lower(F.col(term))], order)


def deduplicate_spans(spans: DataFrame, order: str, key: str = "doc_id") -> DataFrame:
    """The first span for each (start, end) of a document."""
    return first_row(spans, [key, "start", "end"], order)


def conflicts(records: DataFrame, order: str, value: Column | str, text: str = "text") -> DataFrame:
    """(order of the kept row, order of the other, both values) of duplicates whose value differs from the kept row's."""
    v = F.col(value) if isinstance(value, str) else value
    rows = records.where(~T.is_blank(text)).select(T.strip(text).alias("_key"), F.col(order).alias("_o"), v.alias("_v"))
    kept = rows.groupBy("_key").agg(F.min_by(F.struct("_o", "_v"), "_o").alias("k"))
    other = rows.join(kept, "_key").where(F.col("_o") > F.col("k._o")).where(~F.col("_v").eqNullSafe(F.col("k._v")))
    return other.select(F.col("k._o").alias("kept"), F.col("_o").alias("other"), F.col("k._v").alias("kept_value"), F.col("_v").alias("other_value"))


def dedup_stats(records: DataFrame, order: str, value: Column | str, text: str = "text") -> DataFrame:
    """One row: rows read, blank, kept, duplicates, and duplicates in conflict."""
    v = F.col(value) if isinstance(value, str) else value
    rows = records.select(T.is_blank(text).alias("_blank"), T.strip(text).alias("_key"), F.col(order).alias("_o"), v.alias("_v"))
    groups = rows.where("not _blank").groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    a = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("_blank").alias("blank")).withColumn("_one", F.lit(1))
    b = groups.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).withColumn("_one", F.lit(1))
    c = conflicts(records, order, value, text).agg(F.count(F.lit(1)).alias("conflicts")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").join(c, "_one").drop("_one")


def duplicates_within(records: DataFrame, split: str, text: str = "text") -> DataFrame:
    """Per split: rows minus distinct texts that aren't blank."""
    return records.groupBy(split).agg((F.count(F.lit(1)) - F.count_distinct(F.when(~T.is_blank(text), T.strip(text)))).alias("duplicates"))
