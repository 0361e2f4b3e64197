"""Dedup, leakage, splits, similarity, curation, sources and streaming."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F
from spanloom.operators import dedup as D
from spanloom.operators import leakage as K
from spanloom.operators import mining as M
from spanloom.operators import similarity as S
from spanloom.operators import split as P
from spanloom.operators import synth as Y
from spanloom.operators.components import connected_components
from spanloom.operators.scratch import Scratch
from spanloom.sources import readers, writers
from spanloom.streaming import extract as stream

TEXTS = [(0, " Same text "), (1, "Same text"), (2, "same  text"), (3, "Same\ttext"), (4, "   "), (5, ""), (6, None), (7, "other")]


def test_which_copies_are_one(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    ids = lambda x: sorted(r.doc_id for r in x.collect())
    assert ids(D.deduplicate_records(df, "doc_id")) == [0, 2, 3, 7]
    assert ids(D.deduplicate_normalised(df.where("text is not null"), "doc_id")) == [0, 4, 7]
    assert ids(D.deduplicate_collapsed(df.where("text is not null"), "doc_id")) == [0, 2, 4, 7]
    assert ids(D.deduplicate_accepted(df, F.col("doc_id") > 0, "doc_id")) == [1, 2, 3, 4, 6, 7] or ids(D.deduplicate_accepted(df, F.col("doc_id") > 0, "doc_id"))[:3] == [1, 2, 3]
    labelled = df.withColumn("v", F.col("doc_id") % 2)
    assert [(r.kept, r.other) for r in D.conflicts(labelled, "doc_id", "v").collect()] == [(0, 1)]


def test_components_and_split(spark):
    rows = [(0, "One one. Shared a."), (1, "Shared a. Shared b!"), (2, "Shared b! Else."), (3, "Alone.")] + [(i, f"Number {i}.") for i in range(4, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = {r.doc_id: r.component for r in P.sentence_components(df, Scratch(spark, "t")).collect()}
    assert [c[i] for i in range(4)] == [0, 0, 0, 3]
    s = {r.doc_id: r.split for r in P.component_split(df, Scratch(spark, "t"), "doc_id").collect()}
    assert s[0] == s[1] == s[2] and len(s) == 40
    assert sum(v == "train" for v in s.values()) <= 28 and sum(v == "dev" for v in s.values()) <= 6 and set(s.values()) == {"train", "dev", "test"}


def test_connected_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_folds_partition_evenly(spark):
    df = spark.createDataFrame([(i * 3, "a" if i % 4 else None) for i in range(203)], "doc_id long, s string")
    for seed in (None, 42):
        rows = P.stratified_folds(df, "s", 5, seed=seed).collect()
        assert len(rows) == 203
        for s in ("a", None):
            n = [sum(r.fold == k and r.s == s for r in rows) for k in range(5)]
            assert max(n) - min(n) <= 1
    sample = P.seeded_sample(df, "s", 7).collect()
    assert sum(r.s == "a" for r in sample) == 7 and sum(r.s is None for r in sample) == 7


def test_contained_items_and_audit(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("ab cd ef gh ij kl".split())
    docs = [(i, " ".join(word() for _ in range(30))) for i in range(40)]
    items = [(i, docs[i][1][rnd.randrange(0, 20) : rnd.randrange(25, 60)]) for i in range(20)] + [(30, "ab"), (31, "zz yy xx ww"), (32, "  ")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in K.contained_items(d, b, "item_id").collect()}
    assert got == {(i, j) for i, t in docs for j, x in items if x.strip() and x in t}
    a = {r.check: (r.passed, r.n) for r in K.audit({"none": b.where("item_id = 99"), "some": b, "info": b}, ("info",)).collect()}
    assert a == {"none": (True, 0), "some": (False, 23), "info": (True, 23)}


def test_word_jaccard_finds_every_pair(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randrange(1, 7)))
    a, b = [(i, text()) for i in range(50)], [(i, text()) for i in range(50)]
    got = {(r.l, r.r) for r in K.word_jaccard_pairs(spark.createDataFrame(a, "l long, text string"), spark.createDataFrame(b, "r long, text string"), 0.6, "l", "r").collect()}
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    assert got == {(i, j) for i, x in a for j, y in b if jac(x, y) >= 0.6}


def test_ratio_pairs_against_difflib(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(5, 40))).strip() or "x" for _ in range(25)]
    other = [s[:-2] + rnd.choice("ab") + s[-1:] for s in base] + base[:3]
    a, b = list(enumerate(base)), list(enumerate(other))
    got = {(r.l, r.r): r.ratio for r in S.ratio_pairs(spark.createDataFrame(a, "l long, text string"), spark.createDataFrame(b, "r long, text string"), 0.7, "l", "r").collect()}
    norm = lambda s: " ".join(s.lower().split())
    want = {(i, j): difflib.SequenceMatcher(None, norm(x), norm(y)).ratio() for i, x in a for j, y in b if norm(x) and norm(y)}
    assert got == {k: v for k, v in want.items() if v >= 0.7}


def test_relocation():
    assert Y.place_all("Use CSS, then css now", [("css", "A"), ("CSS", "B")]) == [{"start": 4, "end": 7, "label": "B"}, {"start": 14, "end": 17, "label": "A"}]
    assert Y.place_all("xcss css_ 1", [("css", "A")]) == [{"start": 5, "end": 8, "label": "A"}]
    assert Y.place_all("no place", [("css", "A")]) is None and Y.place_all("a", [(" ", "A")]) is None and Y.place_all("a", []) == []


def test_generated_answers(spark):
    answers = [
        (1, '```json\n{"records": [{"text": "Fix the printer today", "entities": [{"term": "printer", "type": "ENTITY"}]}]}\n```'),
        (2, 'Sure: [{"text": "Filing of forms done", "entities": ["CLERICAL_TERM: Filing", "none"]}] bye'),
        (3, json.dumps({"text": "Plain text without any", "entities": []})), (4, "nothing"), (5, None),
        (6, json.dumps([{"text": "Some words here", "entities": ["absent thing"]}, {"no": 1}])),
        (7, json.dumps({"text": "Office sheet filled in", "entities": '{"text": "sheet"}'})),
    ]
    got = {r.response_id: r.entities and [(e.start, e.end, e.label) for e in r.entities] for r in Y.parse_responses(spark.createDataFrame(answers, "response_id long, raw string")).collect()}
    assert got == {1: [(8, 15, "IT_TERM")], 2: [(0, 6, "CLERICAL_TERM")], 3: [], 6: None, 7: [(7, 12, "CLERICAL_TERM")]}
    out = Y.accept_generated(spark.createDataFrame(answers, "response_id long, raw string"), spark.createDataFrame([("plain text without any",)], "key string"), None, Y.quality_reason(bare=("printer",)))
    assert sorted(r.text for r in out.collect()) == ["Filing of forms done", "Office sheet filled in"]


def test_hard_negatives(spark):
    docs = spark.createDataFrame([(1, "good one"), (2, "held back"), (3, "annotated"), (4, "good one")], "doc_id long, text string")
    preds = spark.createDataFrame([(i, 0, 4, t, "A", c) for i, t, c in ((1, "good", 0.85), (1, "One", 0.84), (2, "held", 0.9), (3, "anno", 0.9), (4, "GOOD", 0.9))], "doc_id long, start int, end int, term string, category string, confidence double")
    got = M.hard_negatives(docs, preds, spark.createDataFrame([(3,)], "doc_id long"), spark.createDataFrame([("held back",)], "key string")).collect()
    assert [(r.doc_id, r.false_positive_term) for r in got] == [(1, "good")]


def test_sources(spark, tmp_path):
    (tmp_path / "terms.csv").write_text('term,label\nCSS,IT_TASK\n" data entry ",CLERICAL\ncss,OTHER\nCSS,CLERICAL\n ,IT_TASK\n')
    t = readers.load_terms(spark, str(tmp_path / "terms.csv"))
    assert sorted((r.ord, r.term, r.label) for r in t.collect()) == [(1, "data entry", "CLERICAL_TERM"), (2, "CSS", "CLERICAL_TERM"), (3, "css", "OTHER")]
    assert {r.term for r in readers.known_terms(t).collect()} == {"css", "data entry"} and readers.terms_by_label(t).count() == 1
    (tmp_path / "a.jsonl").write_text('# note\n\n{"text": "one", "entities": [{"start": 0, "end": 3, "label": "A"}]}\n{broken\n{"text": "two"}\n')
    assert [r.text for r in readers.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl")).collect()] == ["one", "two"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    lines = spark.createDataFrame([(1, '{"text": "a"}'), (2, "{x"), (3, "{}"), (4, '{"text": "a", "entities": 3}'), (5, " ")], "line int, value string")
    assert {r.line: r.error for r in readers.validate_jsonl(lines).collect()} == {1: None, 2: "malformed JSON", 3: "no text", 4: "entities is not a list"}
    assert readers.read_batch(spark, str(tmp_path / "a.jsonl")).count() == 2 and readers.read_single(spark, str(tmp_path / "a.jsonl")).first().text == "one"
    assert readers.read_raw_texts(spark, str(tmp_path)).count() == 2
    writers.write_jsonl(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert json.loads(writers.report_json(t.limit(1)).first().report)["label"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Use css and CSS"), (2, " "), (3, "x" * 100_001)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("css", "IT_TERM", 1)], "term string, label string, ord int")
    q = stream.extract_stream(stream.documents_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), terms, str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))
    q.awaitTermination(60)
    assert [(r.doc_id, r.frequency) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
