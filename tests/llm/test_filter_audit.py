import itertools
import random
from collections import defaultdict

from spanloom.llm import filter_audit
from spanloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, part string, mask int, n long"


def brute(docs, labels):
    fails, good, bad = [], set(), set()
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        bad |= {i} if t == 1 else set()
    for i, text, lang, *_ in docs:
        b = (text or "").encode()
        w = b.split()
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum(65 <= c <= 90 for c in b) > 10 * len(text or ""), "D": any(c in b"#$%&*|" for c in b)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, *_ in docs)
        fails.append((lang or "", f, i in good and i is not None, i in bad and i is not None))
    out = []
    for part in {r[0] for r in fails}:
        rows, shapley = [r for r in fails if r[0] == part], defaultdict(int)
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                here = [r for r in rows if r[1][x] and not any(r[1][y] for y in order[:k])]
                shapley[x] += len(here)
                steps.append([part, order, k + 1, sum(not any(r[1][y] for y in order[: k + 1]) for r in rows), len(here), sum(r[1][x] and any(r[1][y] for y in order[:k]) for r in rows),
                              sum([y for y in "ABCDE" if r[1][y]] == [x] for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), x])
        out += [tuple(s[:9]) + (shapley[s[9]],) for s in steps]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(["alpha", "Beta", "GAMMA", "d%", "eé", "x" + str(rnd.randrange(300))]) for _ in range(rnd.choice([3, 90, 110, 140])))
    pool = [text() for _ in range(25)] + [None, "", " \n", "A", "A\x0bA\x1cA", "word " * 60_000, " ".join(f"w{k}" for k in range(40_000))]
    docs = [(i, rnd.choice(pool), rnd.choice(["en", "de", None, ""]), "x", 7, 1) for i in range(150)]
    docs += [(None, "A", "en", "", 0, 0), (None, "A", "en", "", 0, 0), (3, "A", "de", "", 0, 0), (3, "A", "de", "", 0, 0), (9, "twice", "en", None, 1, 1), (9, "twice", "en", None, 1, 1)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (777, 1, 1)]
    d, lab = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(d, lab, Scratch(spark, "t"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a", None, "", 0, 0)], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels, Scratch(spark, "t")).count() == 0
    one = filter_audit.audit(docs, labels, Scratch(spark, "t")).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120


def test_one_text_in_many_copies_is_few_rows(spark):
    docs = spark.range(20_000, numPartitions=5).selectExpr("id as doc_id", "'one text' as text", "if(id % 2 = 0, 'a', 'b') as lang", "'' as part", "0 as mask", "0L as n")
    cells = filter_audit.mask_cells(filter_audit.document_masks(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic").limit(0)), 4)
    assert sorted((r.part, r["mask"], r.n) for r in cells.collect()) == [("a", 1, 1), ("a", 17, 9_999), ("b", 17, 10_000)]
