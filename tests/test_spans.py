"""Hand-made situations for matching, conflicts, merging, trimming and evaluation."""

import random

import pytest
from pyspark.sql import functions as F
from spanloom.functions import labels as L
from spanloom.functions import text as T
from spanloom.operators import dictionary as D
from spanloom.operators import edit as E
from spanloom.operators import metrics as M
from spanloom.operators import resolve as R
from spanloom.operators import summary as S

ENT = "doc_id long, start int, end int, term string, category string, confidence double, source string, status string"


def ents(spark, rows, source):
    return spark.createDataFrame([(1, s, e, t, c, p, source, L.ACCEPTED) for s, e, t, c, p in rows], ENT)


def resolve(spark, ml, dic):
    out, events = R.resolve_conflicts(ents(spark, ml, "ML"), ents(spark, [(*x, 1.0) for x in dic], "dictionary"))
    return sorted((r.start, r.end, r.category, r.source, r.confidence) for r in out.collect()), [(r.term, r.ml_label, r.winning_label, r.start, r.end) for r in events.collect()]


def test_dictionary_inside_longer_model_span_goes(spark):
    for s, e in ((0, 4), (5, 9), (10, 14)):
        got, events = resolve(spark, [(0, 14, "aaaa bbbb cccc", "A", 0.9)], [(s, e, "x", "A")])
        assert got == [(0, 14, "A", "ML", 0.9)] and events == []


def test_label_of_dictionary_wins(spark):
    got, events = resolve(spark, [(0, 4, "aaaa", "B", 0.7)], [(0, 4, "aaaa", "A")])
    assert got == [(0, 4, "A", "dictionary", 0.7)] and events == [("aaaa", "B", "A", 0, 4)]


def test_abstention_and_longer_dictionary_span(spark):
    assert resolve(spark, [], [(2, 5, "abc", "A")])[0] == [(2, 5, "A", "dictionary", 1.0)]
    got, events = resolve(spark, [(0, 4, "aaaa", "B", 0.9)], [(0, 9, "aaaa bbbb", "A")])
    assert got == [(0, 9, "A", "dictionary", 1.0)] and events == [("aaaa bbbb", "B", "A", 0, 9)]


def test_last_of_two_linked_spans_and_vanishing_short_span(spark):
    assert resolve(spark, [(0, 14, "m", "C", 0.9)], [(0, 4, "x", "A"), (5, 9, "y", "B")])[0] == [(0, 14, "B", "dictionary", 0.9)]
    assert resolve(spark, [(4, 8, "m", "A", 0.9)], [(0, 7, "long", "A"), (6, 8, "z", "A")])[0] == [(0, 7, "A", "dictionary", 1.0)]


@pytest.mark.parametrize(
    ("term", "known", "expected"),
    [
        ("graphics card is", None, (0, 13, "graphics card")),
        ("Processing Police Clearance", None, (11, 27, "Police Clearance")),
        ("is", None, None), ("IS", None, (0, 2, "IS")), ("the of", None, None),
        ("the data of the", None, (4, 8, "data")), ("  the  (and) report, is ", None, (13, 20, "report,")),
        ("processing unit", ["processing unit"], (0, 15, "processing unit")), ("the OF", None, (4, 6, "OF")),
    ],
)
def test_trimming(spark, term, known, expected):
    df = spark.createDataFrame([(1, 0, len(term), term)], "doc_id long, start int, end int, term string")
    k = None if known is None else spark.createDataFrame([(x,) for x in known], "term string")
    got = [(r.start, r.end, r.term) for r in R.trim_spans(df, k).collect()]
    assert got == ([] if expected is None else [expected])


def test_merging(spark):
    text = "alpha beta, gamma delta of eps"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [(0, 5, "alpha", "A", 0.9), (6, 10, "beta", "A", 0.7), (12, 17, "gamma", "A", 0.9), (18, 23, "delta", "B", 0.9), (24, 26, "of", "B", 0.9)]
    got = sorted((r.start, r.end, r.confidence, r.status) for r in R.merge_adjacent(ents(spark, rows, "ML"), docs).collect())
    assert got == [(0, 10, 0.7, "NEEDS_REVIEW"), (12, 17, 0.9, "ACCEPTED"), (18, 23, 0.9, "ACCEPTED"), (24, 26, 0.9, "ACCEPTED")]
    nested = [(0, 10, "alpha beta", "A", 0.9), (0, 5, "alpha", "A", 0.8)]
    assert [(r.start, r.end) for r in R.merge_adjacent(ents(spark, nested, "ML"), docs).collect()] in ([(0, 5)], [(0, 10)])


def terms(spark, rows):
    return spark.createDataFrame([(t, c, i + 1) for i, (t, c) in enumerate(sorted(rows, key=lambda r: -len(r[0])))], "term string, label string, ord int")


def test_matching_boundaries_offsets_and_ways(spark):
    t = terms(spark, [("css", "A"), ("C#", "A"), ("web css", "B"), ("IS", "A")])
    docs = spark.createDataFrame([(1, "😀 Web CSS, css_x is IS xC# C#y c#."), (2, None), (3, "")], "doc_id long, text string")
    scan = sorted(map(tuple, D.match_terms(docs, t).collect()))
    assert scan == sorted(map(tuple, D.match_terms(docs, t, limit=0).collect()))
    assert sorted((r.start, r.end, r.term) for r in D.find_term_spans(docs, t).collect()) == [(2, 9, "Web CSS"), (17, 19, "is"), (20, 22, "IS"), (31, 33, "c#")]
    assert [(r.start, r.term) for r in D.dictionary_entities(docs, t).collect() if r.term.upper() == "IS"] == [(20, "IS")]


def test_greedy_takes_no_overlaps(spark):
    rnd = random.Random(2)
    rows = [(d, s, s + rnd.randrange(1, 9)) for d in range(5) for s in [rnd.randrange(60) for _ in range(40)]]
    got = D.filter_spans(spark.createDataFrame(rows, "doc_id long, start int, end int")).collect()
    for d in range(5):
        own, want = sorted((r.start, r.end) for r in got if r.doc_id == d), []
        for s, e in sorted({(s, e) for k, s, e in rows if k == d}, key=lambda x: (x[0] - x[1], x[0])):
            if all(min(e, b) <= max(s, a) for a, b in want):
                want.append((s, e))
        assert own == sorted(want)


SPAN = "doc_id long, idx int, start int, end int, label string, term string"


def slow_status(gold, preds):
    out, used = [], set()
    for g in gold:
        status = "false_negative"
        for i, p in enumerate(preds):
            if (p[0], p[1]) == (g[0], g[1]):
                status = "correct" if p[2] == g[2] else "label_error"
                used.add(i)
                break
            if p[0] < g[1] and p[1] > g[0]:
                status = "boundary_error"
                used.add(i)
        out.append(status)
    return sorted(out + ["false_positive"] * (len(preds) - len(used)))


def test_status_against_a_loop(spark):
    rnd = random.Random(8)
    gold, preds, want = [], [], {}
    for d in range(60):
        make = lambda: [(s, s + rnd.randrange(1, 5), rnd.choice("AB")) for s in sorted(rnd.sample(range(20), rnd.randrange(0, 6)))]  # noqa: B023, E731
        g, p = make(), make()
        gold += [(d, i, s, e, c, "t") for i, (s, e, c) in enumerate(g)]
        preds += [(d, i, s, e, c, "t") for i, (s, e, c) in enumerate(p)]
        want[d] = slow_status(g, p)
    rows = M.classify_status(spark.createDataFrame(gold, SPAN), spark.createDataFrame(preds, SPAN)).collect()
    for d in range(60):
        assert sorted(r.status for r in rows if r.doc_id == d) == want[d]


def test_strict_counts_and_empty_inputs(spark):
    g = spark.createDataFrame([(1, 0, 3, "A"), (1, 0, 3, "A"), (1, 5, 7, "B")], "doc_id long, start int, end int, label string")
    p = spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 7, "A")], "doc_id long, start int, end int, label string")
    assert {r.label: (r.tp, r.fp, r.fn) for r in M.strict_counts(g, p).collect()} == {"A": (1, 1, 1), "B": (0, 0, 1)}
    none = M.with_overall(M.strict_counts(g.limit(0), p.limit(0))).select(*M.prf(F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0)), F.coalesce("fn", F.lit(0)))).collect()
    assert all((r.precision, r.recall, r.f1) == (0, 0, 0) for r in none)


def test_lenient_two_golds_in_one_prediction(spark):
    g = spark.createDataFrame([(1, "Data", "A"), (1, "entry", "A"), (1, "x", "B")], "doc_id long, term string, label string")
    p = spark.createDataFrame([(1, "data entry", "A", 0.9)], "doc_id long, term string, label string, confidence double")
    r = M.lenient_counts(g, p).first()
    assert (r.tp, r.fp, r.fn, r.total_gold) == (2, 0, 1, 3)


def test_summary(spark):
    e = ents(spark, [(0, 3, "Css", "IT_TERM", 1.0), (5, 8, " css ", "IT_TERM", 1.0), (9, 12, "form", "CLERICAL_TERM", 1.0)], "dictionary")
    s = S.summarise(S.deduplicate_entities(e)).first()
    assert (s.total_occurrences, s.unique_entities, s.IT_TERM, s.CLERICAL_TERM, s.IT_TERM_percentage) == (3, 2, 1, 1, 50.0)


def test_bulk_edit(spark):
    docs = spark.createDataFrame([(1, "css and CSS and my css file"), (2, "none")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3, "B", "css"), (1, 16, 22, "A", "my css")], "doc_id long, start int, end int, label string, term string")
    new, changes = E.sync_add(docs, spans, "CSS", "A")
    assert sorted((r.start, r.action) for r in changes.collect()) == [(0, "relabelled"), (8, "added"), (19, "skipped")]
    assert sorted((r.start, r.end, r.label) for r in new.collect()) == [(0, 3, "A"), (8, 11, "A"), (16, 22, "A")]
    assert E.change_counts(changes).first()[:] == (1, 1, 1)
    assert E.set_entity(spans, 1, 2, 5, "A").count() == 2 and E.set_entity(spans, 1, 4, 7, "A").count() == 3 and E.set_entity(spans, 1, 0, 3, None).count() == 1


def test_thresholds(spark):
    r = spark.createDataFrame([(0.8, 0.0, None), (0.79, 2.0, 0.5)], "c double, p double, q double").select(L.route("c").alias("s"), L.clamp_confidence("p").alias("p"), L.clamp_confidence("q").alias("q")).collect()
    assert [tuple(x) for x in r] == [("ACCEPTED", 0.85, 0.85), ("NEEDS_REVIEW", 0.9999, 0.5)]


def test_text_forms(spark):
    r = spark.createDataFrame([("  A\t b C \n",)], "x string").select(T.strip("x").alias("a"), T.collapse("x").alias("b"), T.normalise("x").alias("c"), T.sentences(F.lit("One. Two!  Three? ")).alias("d")).first()
    assert tuple(r) == ("A\t b C", "A b C", "a b c", ["One.", "Two!", "Three?"])
