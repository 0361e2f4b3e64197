from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from spanloom.llm import mixing

DDL = "doc_id long, text string, source string, size string, s int, quota int"


def brute_targets(sizes, weights=(5, 2, 1), times=3):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(times * sizes[n] for n in full)
        free = [n for n in names if n not in full]
        t = {n: times * sizes[n] for n in full} | {n: rest * w[n] / sum(w[m] for m in free) for n in free}
        over = {n for n in free if t[n] > times * sizes[n]}
        if not over:
            return t
        full |= over


def rows():
    out = [(i, " ".join(["w"] * (i * 7 % 90)), f"s{i % 4}" if i % 3 else "s0", "x", 1, 1) for i in range(600)]
    return out + [(None, "one two", None, None, None, None), (7, None, "s1", None, 0, 0), (7, None, "s1", None, 0, 0), (8, "long " * 30_000, "s2", "", 0, 0), (9, "a b c", "tiny", "", 0, 0), (10, "", "void", "", 0, 0)]


def test_targets_and_taken(spark):
    df = spark.createDataFrame(rows(), DDL)
    got = mixing.Mix(df, block_words=32, shard_slots=64).taken().collect()
    assert len(got) == len(rows())
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], rel=1e-9)
        assert abs(taken[s] - expected[s]) <= 1
    again = mixing.Mix(df.repartition(5), block_words=32, shard_slots=64).taken().collect()
    key = lambda r: (r.id is None, r.id or 0, r.source or "", r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_each_pass_takes_each_block_once(spark):
    df = spark.createDataFrame(rows(), DDL)
    plan = mixing.Mix(df, block_words=16, shard_slots=128).plan()
    assert plan.groupBy("s", "pass", "block").count().where("count > 1").count() == 0
    assert plan.groupBy("shard").count().where("count > 128").count() <= 1
    per_shard = {(r.shard, r.s): r["count"] for r in plan.groupBy("shard", "s").count().collect()}
    assert len(set(per_shard.values())) > 3


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        out = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(out) == list(range(n))
        assert n < 90 or out != sorted(out)


def test_empty(spark):
    assert mixing.Mix(spark.createDataFrame([], DDL)).taken().count() == 0


def test_documents_of_the_mix(spark):
    data = [r for r in rows() if r[0] is not None]
    df = spark.createDataFrame([(r[0], r[1] and " ".join(f"w{r[0]}_{k}" for k in range(len(r[1].split()))), r[2], "keep", 3, 4) for r in data], DDL)
    taken = mixing.Mix(df, block_words=32, shard_slots=64).taken().groupBy("id", "source").agg(F.sum("taken").alias("taken")).collect()
    out = mixing.Mix(df, block_words=32, shard_slots=64).documents()
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        words = r.text.split()
        assert words and words == sorted(set(words), key=lambda w: int(w.rpartition("_")[2])) and r["size"] == "keep"
        got[r.doc_id, r.source] += len(words)
    assert {k: v for k, v in got.items()} == {(r.id, r.source): r.taken for r in taken if r.taken}
