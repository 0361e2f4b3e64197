"""Exact dedup by two passes over Bloom filters of hashes (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bloom
from .common import Scratch, key64, quoted, text_of, unused

#: Slots of the first filter for each row, as a power of two: a unique text shares its slot with another by a chance of 1 in 64.
SLOTS_PER_ROW = 6
#: Rows that go are named by broadcast up to this number (16 bytes each); beyond, only rows that pass a filter of them are shuffled.
MAX_BROADCAST = 1_000_000


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, max_words: int) -> DataFrame:
    """(id, sha, rid, _top, _n): each row with its group's best row and size."""
    thin = scratch.save(docs.select(F.col(quoted(id_col)).alias("id"), _sha(quoted(text_col)).alias("sha")).withColumn("rid", F.monotonically_increasing_id()), "hashes")
    n = thin.count()
    bits = min(62, max(31, math.ceil(math.log2(max(1, n))) + SLOTS_PER_ROW))
    slot = F.shiftrightunsigned(key64(F.col("sha")), 64 - bits)
    slotted = thin.withColumn("slot", slot.cast("int") if bits == 31 else slot)
    twice = scratch.save(slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot"), "twice")
    words = bloom.n_words(twice.count())
    filled = bloom.build(twice, key64(F.col("slot")), words)
    probed = scratch.save(bloom.probe(slotted, key64(F.col("slot")), filled, words, "_hit", broadcast=words <= max_words).drop("slot"), "probed")
    scratch.drop(thin, twice)
    order = F.struct(F.col("id"), F.col("rid"))
    suspects = probed.where("_hit")
    groups = scratch.save(suspects.groupBy("sha").agg(F.max(order).alias("_top"), F.count(F.lit(1)).alias("_n")), "groups")
    large = F.col("_n") > max(1000, n // 1000)
    out = ["id", "sha", "rid", "_top", "_n"]
    near = suspects.join(F.broadcast(groups.where(large)), "sha", "left")
    rest = near.where(F.col("_n").isNull()).drop("_top", "_n").join(groups.where(~large), "sha")
    alone = probed.where("not _hit").withColumn("_top", order).withColumn("_n", F.lit(1).cast("long"))
    return alone.select(out).unionByName(near.where(F.col("_n").isNotNull()).select(out)).unionByName(rest.select(out))


def duplicate_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", max_words: int = bloom.MAX_WORDS) -> DataFrame:
    """Each row's id, hash and group: (id, text_sha256, keep_id, group_size, kept).

    Texts are equal if identical; null counts as empty. Of a group, the row with the largest id stays; ids that are null rank
    last, and of rows that agree in id and text one stays. Other columns are not read; an empty table gives an empty one.

    Pass 1 is a counting Bloom filter with one hash: each text falls in one of 64 slots a row, or more, and the slots are counted, first in each task.
    What is sent is a number of 31 bits (more only beyond 30 million rows) for each slot in use in a task, never a row. Slots that were
    hit twice fill a second, blocked filter. Pass 2 tests each row against it: rows that miss it are unique and pass straight
    through, only the others shuffle. False positives cost a shuffle and change no result. The second filter grows with the number of
    repeated slots; up to max_words words it is broadcast, beyond that ids and hashes meet it by a shuffle. A group with over
    a thousandth of the rows is sent back by broadcast (there are under a thousand such groups), so its rows
    never meet in one task; counts and maxima are combined before the shuffle.
    """
    return _groups(docs, scratch, id_col, text_col, max_words).select(
        F.col("id"),
        F.col("_top.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_top.rid") == F.col("rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = bloom.MAX_WORDS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; see duplicate_groups.

    Texts stay where they are: the rows that go are known by two 64-bit hashes of id and text, and taken away by a
    broadcast join. Beyond max_broadcast such rows, all rows are tested against a Bloom filter of them; rows that miss it pass
    straight through and the others meet the list by a shuffle. Rows that agree in id and text cannot be told apart, so one of them is taken by a
    grouping of just those.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    k1, k2, twin, hit, word, bits, sha = unused(docs, "_k1", "_k2", "_twin", "_hit", "_word", "_bits", "_sha")
    keys = lambda i, s: [F.xxhash64(i, s).alias(k1), F.xxhash64(s, i, F.lit(1)).alias(k2)]
    groups = _groups(docs, scratch, id_col, text_col, max_words).where("_top.rid <> rid")
    lost = groups.select(*keys(F.col("id"), F.col("sha")), F.col("_top.id").eqNullSafe(F.col("id")).alias(twin))
    lost = scratch.save(lost.groupBy(k1, k2).agg(F.max(twin).alias(twin)), "lost")
    n, twins = lost.agg(F.count(F.lit(1)), F.count_if(twin)).first()
    if not n:
        return docs
    own = F.col(quoted(id_col))
    rows = docs.withColumn(sha, _sha(quoted(text_col)))
    rows = rows.withColumns({k1: F.xxhash64(own, F.col(sha)), k2: F.xxhash64(F.col(sha), own, F.lit(1))}).drop(sha)
    if n <= max_broadcast:
        marked = rows.join(F.broadcast(lost), [k1, k2], "left")
        stay = marked.where(F.col(twin).isNull())
    else:
        words = min(bloom.n_words(n), bloom.MAX_WORDS)
        filled = scratch.save(bloom.build(lost, F.col(k1), words, (word, bits)), "filter")
        tested = bloom.probe(rows, F.col(k1), filled, words, hit, (word, bits))
        marked = tested.where(hit).drop(hit).join(lost, [k1, k2], "left")
        stay = tested.where(~F.col(hit)).drop(hit).unionByName(marked.where(F.col(twin).isNull()).drop(twin))
    stay = stay.select(*[quoted(c) for c in docs.columns])
    if not twins:
        return stay
    again = marked.where(F.col(twin)).dropDuplicates([k1, k2])
    return stay.unionByName(again.select(*[quoted(c) for c in docs.columns]))
