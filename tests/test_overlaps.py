"""Spans that meet: bins against brute force, over long documents, long spans, nulls and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F
from spanloom.operators import dictionary as D
from spanloom.operators import metrics as M
from spanloom.operators import overlaps as R

SPANS = "doc_id long, start int, end int, tag string"


def dealt(rnd, docs, n, longest):
    out = []
    for d in docs:
        for k in range(n):
            start = rnd.randrange(0, 6000)
            out.append((d, start, start + rnd.choice([0, 1, 5, 40, R.BIN, longest]), f"{d}-{k % (n - 2)}"))
    return out + out[:3]


def brute(left, right, how):
    out = []
    for x in left:
        met = [y for y in right if None not in (x[0], *x[1:3], *y[:3]) and x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])]
        out += [x + y for y in met] or ([x + (None,) * 4] if how == "left" else [])
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_pairs_equal_brute_force(spark, how):
    rnd = random.Random(5)
    odd = [(None, 3, 9, "a"), (1, None, 9, "b"), (1, 4, None, "c"), (2, 8, 8, "d"), (2, 9, 4, "e"), (7, 0, 10**6, "f"), (7, 0, 10**6, "f"), (1, R.BIN - 1, R.BIN + 1, "g"), (1, R.BIN, R.BIN + 1, "h")]
    left, right = dealt(rnd, [1, 2, 3], 25, 3000) + odd, dealt(rnd, [2, 3, 4], 25, 3000) + odd
    got = R.overlap_join(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), how=how).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(left, right, how)


def test_empty_sides_and_names_in_use(spark):
    left = spark.createDataFrame([(1, 0, 5000, "x")], SPANS).withColumns({"_at": F.lit(1), "_place": F.lit(2)})
    none = spark.createDataFrame([], SPANS)
    rows = R.overlap_join(left, none).collect()
    assert [(r._at, r._place, r.r_start) for r in rows] == [(1, 2, None)]
    assert R.overlap_join(none, left).count() == 0
    with pytest.raises(ValueError):
        R.overlap_join(left, none, how="full")


def test_a_long_document_is_no_product(spark):
    n = 60_000  # a product would be 3.6 billion pairs
    spans = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 20).cast("int").alias("start"), (F.col("id") * 20 + 30).cast("int").alias("end"))
    assert R.overlap_join(spans, spans).count() == 3 * n - 2


def test_holdout_equals_brute_force(spark):
    rnd = random.Random(8)
    words = ["tax", "Tax office", "office", "soft", "software", None]
    row = lambda k: (rnd.randrange(3), k, s := rnd.randrange(0, 2000), s + rnd.choice([3, 30, 900]), rnd.choice(words), rnd.choice("AB"))
    gold, preds = [row(k) for k in range(60)], [row(k) for k in range(15)]
    want = set()
    for d, k, s, e, t, label in gold:
        hits = [p[1] for p in preds if p[0] == d and p[5] == label and (max(s, p[2]) < min(e, p[3]) or (t and p[4] and (t.lower() in p[4].lower() or p[4].lower() in t.lower())))]
        want.add((d, k, label, t, min(hits, default=None)))
    kind = "doc_id int, idx int, start int, end int, term string, label string"
    got = M.holdout_matches(spark.createDataFrame(gold, kind), spark.createDataFrame(preds, kind)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {w[4] is None for w in want} == {True, False}


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = {1: "Ab cd, ef  gh. " * 200, 2: "", 3: "x" * 2000 + " y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = [(d, s, s + rnd.choice([1, 2, 7, 30, 900]), str(k)) for k in range(60) for d in (1, 3) for s in [rnd.randrange(0, 1990)]]
    toks = {}
    for r in D.token_table(docs).collect():
        if r.tok.strip():
            toks.setdefault(r.doc_id, []).append((r.start, r.start + len(r.tok)))
    for mode in ("contract", "expand"):
        want = set()
        for d, s, e, tag in spans:
            met = [t for t in toks[d] if t[0] < e and t[1] > s]
            inside = [t for t in met if t[0] >= s and t[1] <= e]
            use = inside or (met if mode == "expand" else [])
            if use:
                want.add((d, tag, s, e, min(t[0] for t in use), max(t[1] for t in use)))
        got = D.align_spans(D.token_table(docs), spark.createDataFrame(spans, SPANS), mode=mode).select("doc_id", "tag", "raw_start", "raw_end", "start", "end").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
