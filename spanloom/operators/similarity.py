"""Sequence ratios of text pairs."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from .automaton import spread
from .scratch import Scratch


GRAM = 4
#: From this length on difflib doesn't look up characters of over a hundredth of the second text.
LONG = 200


@lru_cache(maxsize=512)
def profile(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """A text's distinct n-grams, their numbers, and the numbers of its characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    grams = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
    for i in range(GRAM if len(grams) else 0):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(grams)]
    return *np.unique(grams, return_counts=True), Counter(text)


def most_matched(a: str, b: str) -> int:
    """An upper bound of the characters that difflib's blocks cover, for a b of LONG characters at least.

    Each block but one at the start of both texts holds a character that difflib looks up, so there are at most `blocks`; each
    has all but GRAM - 1 of its characters as starts of shared n-grams. Equal hashes of unequal n-grams only raise the bound.
    """
    (ga, na, ca), (gb, nb, cb) = profile(a), profile(b)
    popular = len(b) // 100 + 1
    blocks = 1 + sum(min(n, ca.get(c, 0)) for c, n in cb.items() if n <= popular)
    _, i, j = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum()) + (GRAM - 1) * blocks


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits; no choice of blocks covers more."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


#: Characters that shared stretches are compared by at first; longer ones are measured one by one.
FOLLOWED = 32


def _stretches(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The FOLLOWED characters from each place on to the right and to the left, as rows of bytes; unlike characters may have one byte."""
    codes = (np.frombuffer(text.encode("utf-32-le"), np.uint32) % 255 + 1).astype(np.uint8)
    rows = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(FOLLOWED - 1, np.uint8)]), FOLLOWED)
    return rows(codes), rows(codes[::-1])[::-1]


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{FOLLOWED}").ravel()


@lru_cache(maxsize=8)
def _sorted_stretches(text: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.sort(_as_strings(rows)) for rows in _stretches(text))


@lru_cache(maxsize=512)
def _looked_up(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the characters that difflib looks up in a second text, and the stretches there in both directions."""
    _, own, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[own] <= len(text) // 100 + 1)
    return at, *[_as_strings(rows[at]) for rows in _stretches(text)]


def covered(a: str, b: str) -> int:
    """An upper bound of the characters that difflib's blocks cover, for a b of LONG characters at least, tighter than most_matched.

    Each block but one at the start of both texts holds a character that difflib looks up, at a place p of b, and is part of a stretch around p that stands in a
    as well. So no block leaves the union, over all p, of the longest stretches from p to the right and from p to the left that stand in a; these are next to
    p's own among the sorted stretches of a.
    """
    least = min(len(a), len(b))
    lead = next((i for i in range(least) if a[i] != b[i]), least)
    at, *own = _looked_up(b)
    if not len(at):
        return lead
    reach = []
    for side, (mine, theirs) in enumerate(zip(own, _sorted_stretches(a), strict=True)):
        k = np.searchsorted(theirs, mine)
        here = mine.view(np.uint8).reshape(len(mine), FOLLOWED)
        best = np.zeros(len(mine), np.int64)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(theirs) - 1)):
            unlike = here != theirs[j].view(np.uint8).reshape(len(mine), FOLLOWED)
            best = np.maximum(best, np.where(unlike.any(1), unlike.argmax(1), FOLLOWED))
        far = np.flatnonzero(best == FOLLOWED)
        if len(far) > len(at) // 2:
            return len(b)
        for i in far.tolist():
            best[i] = _longest(a, b, int(at[i]), side == 0)
        reach.append(best)
    met = reach[0] > 0
    edge = np.zeros(len(b) + 1, np.int64)
    np.add.at(edge, np.maximum(at[met] - reach[1][met] + 1, 0), 1)
    np.add.at(edge, np.minimum(at[met] + reach[0][met], len(b)), -1)
    return lead + int((np.cumsum(edge)[:-1] > 0).sum())


def _longest(a: str, b: str, p: int, right: bool) -> int:
    """Length of the longest stretch of b from p to the right (or up to p) that stands in a, FOLLOWED at least."""
    most = len(b) - p if right else p + 1
    part = (lambda n: b[p : p + n]) if right else (lambda n: b[p + 1 - n : p + 1])
    low, high = 0, FOLLOWED
    while high < most and part(high) in a:
        low, high = high, 2 * high
    high = min(high, most)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if part(mid) in a else (low, mid - 1)
    return max(low, min(FOLLOWED, most))


def ratio_from(a: str, b: str, least: float) -> float | None:
    """difflib's ratio of a to b if it is least or more, else None; what the bounds rule out is not compared."""
    if a == b:
        return 1.0
    need = least * (len(a) + len(b)) / 2 - 1e-6
    if min(len(a), len(b)) < need:
        return None
    if len(b) < LONG:
        if (profile(a)[2] & profile(b)[2]).total() < need or common_length(a, b) < need:
            return None
    elif most_matched(a, b) < need or covered(a, b) < need:
        return None
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= least else None


def ratios_from(a: Column, b: Column, least: float) -> Column:
    """ratio_from of two columns, pair by pair."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio_from(u, v, least) for u, v in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _bits(text: str, width: int) -> tuple[np.ndarray, int]:
    """A bit for each (n-gram, its number among equal ones) of the text, at a hash below width, and how many of them share another's bit."""
    grams, n, _ = profile(text)
    again = spread(np.zeros(len(n), np.int64), n).astype(np.uint64)
    at = (np.repeat(grams, n) + again * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(width, bool)
    bits[at >> np.uint64(64 - int(width).bit_length() + 1)] = True
    return np.packbits(bits).view(np.uint64), len(at) - int(bits.sum())


#: Bits for each character of a block's longest text, bytes of bits that are compared at a time.
WIDE, AT_ONCE = 8, 1 << 18
#: Lengths that stretches around looked-up characters are tried in; one of the last length counts as one without end.
LEVELS = (1, 2, 3, 4, 6, 8, 11, 16, 24)
_UPTO = np.array([n - 1 for n in LEVELS] + [1 << 40])
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _rolling(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums and factors from which the hash of any stretch comes in one step: (sums[i + n] - sums[i]) * factors[i]."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(codes) - 1), base, np.uint64)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(codes * powers(_BASE)[: len(codes)], dtype=np.uint64)]), powers(_BACK)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(32)).astype(np.uint32)


class _Around:
    """Where a second text has characters that difflib looks up, and the hashes of its stretches of LEVELS characters from there to the right and to the left."""

    def __init__(self, text: str) -> None:
        _, own, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[own] <= len(text) // 100 + 1)
        sums, factors = _rolling(text)
        level = np.array(LEVELS)[:, None]
        begin = np.stack([np.broadcast_to(at, (len(LEVELS), len(at))), at - level + 1])
        self.inside = (begin >= 0) & (begin + level <= len(text))
        begin = np.where(self.inside, begin, 0)
        self.hash = _mixed((sums[np.minimum(begin + level, len(text))] - sums[begin]) * factors[begin])
        self.any = len(at) > 0
        self.gaps = np.diff(np.concatenate([[-1], at, [len(text)]])) - 1


class _Held:
    """Which stretches of LEVELS characters a first text holds, by hash; two of one hash only raise what reached says."""

    def __init__(self, text: str) -> None:
        self.text, bits = text, max(6, (WIDE * len(text)).bit_length())
        sums, factors = _rolling(text)
        self.shift, self.held = np.uint32(32 - min(bits, 31)), np.zeros((len(LEVELS), 1 << min(bits, 31)), bool)
        for row, n in zip(self.held, LEVELS, strict=True):
            if n <= len(text):
                row[_mixed((sums[n:] - sums[:-n]) * factors[: len(text) - n + 1]) >> self.shift] = True

    def reached(self, b: str, around: _Around) -> int:
        """An upper bound of the characters that difflib's blocks cover, for a b of LONG characters at least.

        Each block but one at the start of both texts holds a looked-up character. So between two neighbouring ones of b no more is covered than the longest
        stretch from the first to the right that stands in the first text, and that from the second to the left.
        """
        least = min(len(self.text), len(b))
        lead = next((i for i in range(least) if self.text[i] != b[i]), least)
        if not around.any:
            return lead
        hit = self.held[np.arange(len(LEVELS))[:, None], around.hash >> self.shift] & around.inside
        right, left = _UPTO[np.logical_and.accumulate(hit, axis=1).sum(1)]
        more = np.zeros(len(right) + 1, np.int64)
        more[1:] += np.maximum(right - 1, 0)
        more[:-1] += np.maximum(left - 1, 0)
        return lead + int((right > 0).sum() + np.minimum(around.gaps, more).sum())


class Block:
    """Texts that others are compared with, by length, and their n-grams as bits, so that one bound comes for all of them at once.

    N-grams that two texts share, counted with their numbers, are at most the bits that both have and those of either that share another's bit.
    """

    def __init__(self, texts: list[str], least: float) -> None:
        self.order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.texts, self.least = [texts[i] for i in self.order], least
        self.size = np.array([len(t) for t in self.texts])
        self.width = 1 << max(6, (WIDE * int(self.size[-1]) - 1).bit_length())
        bits = [_bits(t, self.width) for t in self.texts]
        self.bits, self.lost = np.stack([x for x, _ in bits]), np.array([n for _, n in bits])
        rare = [sum(n for n in profile(t)[2].values() if n <= len(t) // 100 + 1) for t in self.texts]
        self.around: dict[int, _Around] = {}
        self.blocks = 1 + np.array(rare)  # no more blocks than this in a comparison with the text as the second one

    def likely(self, text: str) -> np.ndarray:
        """Places in self.texts whose lengths and n-grams allow the ratio with text as the first one."""
        need = self.least * (len(text) + self.size) / 2 - 1e-6
        near = np.flatnonzero(np.minimum(len(text), self.size) >= need)  # next to each other, since they are in the order of their lengths
        if not len(near):
            return near
        a, z = int(near[0]), int(near[-1]) + 1
        own, lost = _bits(text, self.width)
        rows = max(1, AT_ONCE // own.nbytes)
        both = np.concatenate([np.bitwise_count(self.bits[i : min(i + rows, z)] & own).sum(1, dtype=np.int64) for i in range(a, z, rows)])
        most = both + np.minimum(self.lost[a:z], lost) + (GRAM - 1) * self.blocks[a:z]
        return a + np.flatnonzero((self.size[a:z] < LONG) | (most >= need[a:z]))

    def ratios(self, text: str):
        """(number, ratio) of the texts with a ratio of least or more."""
        held = None
        for k in self.likely(text).tolist():
            own = self.texts[k]
            if len(own) >= LONG and own != text:
                held = held or _Held(text)
                if k not in self.around:
                    self.around[k] = _Around(own)
                if held.reached(own, self.around[k]) < self.least * (len(text) + len(own)) / 2 - 1e-6:
                    continue
            ratio = ratio_from(text, own, self.least)
            if ratio is not None:
                yield self.order[k], ratio


#: Texts and characters of each side that meet in one group, about.
BLOCK, BLOCK_CHARS = 600, 2_000_000


def ratio_pairs(left: DataFrame, right: DataFrame, least: float, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """(left_key, right_key, ratio) of normalised texts whose sequence ratio is at least least; blank texts are left out.

    Equal texts of a side are compared once. Texts meet only in neighbouring bands of the logarithm of their lengths: at this ratio the longer is at
    most (2 - least) / least times the shorter. Within a band both sides are cut into blocks, and each pair of blocks is a group, so
    no key fills a task and no pair of texts is a row. A bound by bits of n-grams comes for a whole block at once, then those by
    shared stretches (reached, covered; in short texts by characters), then the ratio itself. All bounds are exact. The pairs of blocks grow with the product of the sides: at a ratio of 0.7 an
    equi-join on shared characters with their numbers, or on shared grams, is exact too but meets most pairs of a band (see README).
    """
    step = math.log((2 - least) / least) or 1e-9
    band = F.floor(F.log(F.greatest(F.length("t"), F.lit(1))) / step)
    scratch = Scratch(left.sparkSession, "ratios")
    side = lambda df, key: scratch.save(df.select(F.col(key).alias("k"), T.normalise(text).alias("t")).where("t <> ''").withColumn("h", F.sha2("t", 256)), "side")
    l, r = side(left, left_key), side(right, right_key)  # noqa: E741
    texts = lambda df: df.groupBy("h").agg(F.first("t").alias("t"))
    near = lambda df: df.withColumn("band", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: band + k)))
    a, b = scratch.save(texts(l).withColumn("band", band), "texts"), scratch.save(near(texts(r)), "texts")
    blocks = lambda df, name: df.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("t")) / BLOCK_CHARS)).alias(name))
    size = scratch.save(blocks(a, "nl").join(blocks(b, "nr"), "band"), "blocks")  # a row for each band
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    a = a.join(F.broadcast(size), "band").withColumn("i", F.pmod(F.xxhash64("h"), "nl")).withColumn("j", F.explode(upto("nr")))
    b = b.join(F.broadcast(size), "band").withColumn("j", F.pmod(F.xxhash64("h"), "nr")).withColumn("i", F.explode(upto("nl")))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if x.num_rows and y.num_rows:
            block, names = Block(y.column("t").to_pylist(), least), y.column("h").to_pylist()
            for h, t in zip(x.column("h").to_pylist(), x.column("t").to_pylist(), strict=True):
                out.extend((h, names[k], ratio) for k, ratio in block.ratios(t))
        return pa.table({"_own": pa.array([o[0] for o in out], pa.string()), "_other": pa.array([o[1] for o in out], pa.string()), "ratio": pa.array([o[2] for o in out], pa.float64())})

    on = ["band", "i", "j"]
    groups = size.agg(F.sum(F.col("nl") * F.col("nr")).cast("long").alias("n")).first().n or 1
    dealt = lambda df: df.select(*on, "h", "t").repartition(int(min(2000, 1 + 2 * groups)), *on).groupBy(*on)  # noqa: E731  (few bytes and much work: not to be put together by their size)
    met = dealt(a).cogroup(dealt(b)).applyInArrow(compare, "_own string, _other string, ratio double")
    named = met.join(l.select(F.col("h").alias("_own"), F.col("k").alias(left_key)), "_own").join(r.select(F.col("h").alias("_other"), F.col("k").alias(right_key)), "_other")
    return named.select(left_key, right_key, "ratio")


def word_then_ratio(left: DataFrame, right: DataFrame, left_key: str, right_key: str, jaccard: float = 0.6, least: float = 0.7, text: str = "text") -> DataFrame:
    """Near-duplicate sentences: equal ones, and those whose word sets are alike and whose ratio is high; the first partner of each left row."""
    from .leakage import jaccard_texts

    both = jaccard_texts(left, right, jaccard, left_key, right_key, text).select(left_key, right_key, F.lower("_left").alias("_own"), F.lower("_right").alias("_other"))
    both = both.withColumn("ratio", ratios_from(F.col("_own"), F.col("_other"), least)).where(F.col("ratio") >= least)
    return both.groupBy(left_key).agg(F.min_by(F.struct(right_key, "ratio"), right_key).alias("m")).select(left_key, f"m.{right_key}", "m.ratio")
