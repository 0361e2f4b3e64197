"""Blocked Bloom filters as tables, built and probed with DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import quoted, unused
from .scratch import Scratch

#: Bits of the filter for each key, and bits that one key sets in its 64-bit word.
BITS_PER_KEY, BITS_PER_HASH = 16, 4
#: Filters of at most so many 64-bit words (about 40 MB as a hash relation) are broadcast; larger ones are joined by shuffle.
MAX_WORDS = 1 << 20


def n_words(keys: int) -> int:
    """Words of a filter for so many keys; a power of two."""
    return 1 << max(10, math.ceil(math.log2(max(1, keys * BITS_PER_KEY / 64))))


def _place(h: Column, words: int) -> tuple[Column, Column]:
    """The word of the filter that a 64-bit hash falls in, and the bits it sets there."""
    mask = None
    for i in range(BITS_PER_HASH):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(words)).cast("long"), mask


def build(keys: DataFrame, h: Column, words: int, names: tuple[str, str] = ("_word", "_bits")) -> DataFrame:
    """The filter of the hashes h of keys: a row for each word in use, combined in each task before the shuffle."""
    word, mask = _place(h, words)
    return keys.select(word.alias(names[0]), mask.alias("m")).groupBy(names[0]).agg(F.bit_or("m").alias(names[1]))


def probe(rows: DataFrame, h: Column, filled: DataFrame, words: int, hit: str, names: tuple[str, str] = ("_word", "_bits"), broadcast: bool = True) -> DataFrame:
    """rows with a boolean column hit: whether the filter may hold h (never false for a key it was built from).

    names, the filter's columns, must be free in rows. With broadcast (asked for only if words <= MAX_WORDS) rows stay where they are.
    """
    word, mask = _place(h, words)
    side = F.broadcast(filled) if broadcast else filled
    wide = rows.withColumn(hit, mask).join(side, word == F.col(names[0]), "left")
    found = F.coalesce(F.col(names[1]).bitwiseAND(F.col(hit)) == F.col(hit), F.lit(False))
    return wide.withColumn(hit, found).drop(*names)


def without(rows: DataFrame, own: list[Column], lost: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """rows whose values own (null equals null) are no row of lost, a saved table of distinct rows.

    Up to limit rows lost is broadcast. Beyond, rows are tested against a Bloom filter of lost: those that miss it
    stay where they are, the others meet lost by a shuffle. own is computed once for each row.
    """
    mine = unused(rows, *[f"_own{i}" for i in range(len(own))])
    keyed = rows.withColumns(dict(zip(mine, own, strict=True)))
    return gone(keyed, mine, lost, limit, scratch)[0].select(*[quoted(c) for c in rows.columns])


def gone(rows: DataFrame, mine: list[str], lost: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows that are not in lost, rows that are) by the columns mine and the first columns of lost, null equal to null; see without. The latter have lost's further columns too."""
    n = lost.count()
    extra = lost.columns[len(mine) :]
    hit, word, bits, mark, *names = unused(rows, "_hit", "_word", "_bits", "_mark", *[f"_gone{i}" for i in range(len(mine))])
    lost = lost.toDF(*names, *extra).withColumn(mark, F.lit(True))
    same = functools.reduce(Column.__and__, [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(mine, names, strict=True)])
    keep = [quoted(c) for c in rows.columns]
    if n <= limit:
        met = rows.join(F.broadcast(lost), same, "left")
        return met.where(F.col(mark).isNull()).select(*keep), met.where(F.col(mark)).select(*keep, *extra)
    words = min(n_words(n), MAX_WORDS)
    filled = scratch.save(build(lost, F.xxhash64(*names), words, (word, bits)), "filter")
    tested = probe(rows, F.xxhash64(*[quoted(c) for c in mine]), filled, words, hit, (word, bits))
    met = tested.where(hit).join(lost, same, "left")
    stay = tested.where(~F.col(hit)).select(*keep).unionByName(met.where(F.col(mark).isNull()).select(*keep))
    return stay, met.where(F.col(mark)).select(*keep, *extra)
