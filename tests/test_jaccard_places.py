"""The word join of near-duplicates: texts without a partner in sight stay where they are, and both ways find all pairs."""

import random

import pytest

from spanloom.operators import leakage as K
from spanloom.plans import registry


@pytest.mark.parametrize("name", ["near_dup_jaccard", "near_dup_sentences"])
def test_document_words_are_not_collected(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # the benchmark's words only


@pytest.mark.parametrize("limit", [0, 1000])
def test_both_ways_find_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(K, "MAX_BROADCAST_TERMS", limit)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9)))
    a, b = [(i, text()) for i in range(80)] + [(80, None)], [(i, text()) for i in range(30)] + [(30, None)]
    got = {(r.l, r.r): r.jaccard for r in K.word_jaccard_pairs(spark.createDataFrame(a, "l long, text string"), spark.createDataFrame(b, "r long, text string"), 0.6, "l", "r").collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            u, v = set((x or "").split()), set((y or "").split())
            if u and v and len(u & v) / len(u | v) >= 0.6:
                want[i, j] = len(u & v) / len(u | v)
    assert got == pytest.approx(want) and want
