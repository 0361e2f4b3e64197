"""Review, edits, reports, sources and answers of generators on small tables of their own."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F
from spanloom.functions import text as T
from spanloom.operators import dictionary as D
from spanloom.operators import edit as E
from spanloom.operators import metrics as M
from spanloom.operators import report as R
from spanloom.operators import similarity as S
from spanloom.operators import split as P
from spanloom.operators import synth as Y
from spanloom.operators.resolve import resolve_conflicts, with_sentences
from spanloom.operators.scratch import Scratch
from spanloom.sources import readers, writers
from spanloom.streaming.extract import batch_run, responses

SPANS = "doc_id long, start int, end int, label string, term string"


def test_answers_of_generators():
    read = Y.read_response
    want = [{"text": "a", "entities": []}]
    assert read(json.dumps(want)) == read("Sure:\n```json\n" + json.dumps(want) + "\n```\nDone [1].") == read(json.dumps({"data": want})) == read("x [3] " + json.dumps(want)) == want
    assert read('{"text": "b"}') == [{"text": "b"}] and read("") == read("nothing") == read("[1, 2]") == read('{"other": 1}') == []
    item = Y.read_entity
    assert item("IT_TERM: Python") == item("Python - it_term") == ("Python", "IT_TERM") or item("Python - it_term") == ("Python", "it_term")
    assert item({"name": " Excel ", "type": "CLERICAL"}) == item('{"name": "Excel", "type": "CLERICAL"}') == ("Excel", "CLERICAL")
    assert item("'plain'") == ("plain", "") and item("None.") is None and item({}) is None and item(5) is None


def test_entities_given_as_text(spark):
    rec = lambda ents: json.dumps([{"text": "We used Python and Excel.", "entities": ents}])
    raws = [rec('[{"text": "Python", "label": "IT_TERM"}]'), rec("none."), rec("[]"), rec({"term": "Excel"}), rec("Python"), rec("[broken"), rec(["Python", "Excel"]), rec("COBOL"), rec(7), rec([None, "none"])]
    df = spark.createDataFrame(list(enumerate(raws)), "response_id int, raw string")
    got = {r.response_id: r.entities and [(e.start, e.end, e.label) for e in r.entities] for r in Y.parse_responses(df).collect()}
    py, ex = (8, 14, "IT_TERM"), (19, 24, "CLERICAL_TERM")
    assert got == {0: [py], 1: [], 2: [], 3: [ex], 4: [py], 5: None, 6: [py, ex], 7: None, 8: None, 9: []}


def test_majority_reaches_places_without_label(spark):
    docs = spark.createDataFrame([(1, "cat dog cat"), (2, "Cat and cat"), (3, "cats, the cat dog")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3, "A", "cat"), (1, 8, 11, "A", "cat"), (2, 0, 3, "B", "Cat"), (3, 10, 17, "B", "cat dog")], SPANS)
    new, changes = E.resolve_to_majority(docs, spans, F.struct("doc_id", "start"))
    assert sorted((r.doc_id, r.start, r.end, r.label, r.term) for r in new.collect()) == [(1, 0, 3, "A", "cat"), (1, 8, 11, "A", "cat"), (2, 0, 3, "A", "Cat"), (2, 8, 11, "A", "cat"), (3, 10, 17, "B", "cat dog")]
    assert sorted((r.doc_id, r.start, r.action) for r in changes.collect()) == [(1, 0, "same"), (1, 8, "same"), (2, 0, "relabelled"), (2, 8, "added"), (3, 10, "skipped")]
    edited, _ = E.sync_edit(docs, spans, "cat", "dog", "C")
    assert sorted((r.doc_id, r.start, r.label) for r in edited.collect()) == [(1, 4, "C"), (3, 10, "B")]
    relabelled, changed = E.sync_edit(docs, spans, "cat", "CAT", "B")
    assert relabelled.where("label = 'B'").count() == 4 and changed.count() == 2
    more = E.add_record(docs, 9, "  new one ")
    assert more.where("doc_id = 9").first().text == "new one"
    raw = spark.createDataFrame([(1, 1, 6, "A"), (1, 1, 2, "B")], "doc_id long, start int, end int, label string")
    assert [(r.start, r.end) for r in D.aligned_records(docs, raw).collect()] in ([(0, 3)], [(0, 7)])


def test_reports_and_filters(spark, tmp_path):
    items = spark.createDataFrame([("one Cat", [("correct", "cat", "A", "cat", "A", "ML")]), ("two", [("false_positive", None, None, "dog", "B", "dictionary")]), ("three", [])], "text string, entity_results array<struct<status:string,gold_term:string,gold_label:string,pred_term:string,pred_label:string,pred_source:string>>")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(R.filter_documents(items)) == ["one Cat", "three", "two"] and texts(R.filter_documents(items, query="DOG")) == ["two"] and texts(R.filter_documents(items, query="cat", label="A", source="ML", status="correct")) == ["one Cat"]
    rows = spark.createDataFrame([("10", 1), ("9", 2), ("b", 3), ("a", 4), (None, 5)], "v string, n int")
    assert [r.n for r in R.sort_rows(rows, "v").collect()] == [2, 1, 4, 3, 5] and [r.n for r in R.sort_rows(rows, "v", True).collect()] == [1, 2, 3, 4, 5]
    docs = spark.createDataFrame([(1, "Dog cat dog cat Bird")], "doc_id long, text string")
    st = spark.createDataFrame([(1, 12, 15, None, None, "cat"), (1, None, None, None, None, "bird"), (1, 0, 3, None, None, "fish"), (1, 0, 3, 1, 2, "x")], "doc_id long, gold_start int, gold_end int, pred_start int, pred_end int, pred_term string")
    assert sorted((r.pred_term, r.pred_start, r.pred_end) for r in R.enrich_offsets(st, docs).collect()) == [("bird", 16, 20), ("cat", 12, 15), ("fish", None, None), ("x", 1, 2)]
    one = spark.range(1).select(F.array(F.lit(3), F.lit(9), F.lit(5)).alias("p"))
    assert one.select(R.nearest_place("p", F.lit(6)).alias("x"), R.lift(F.lit(2.5), F.lit(3.0)).alias("y")).first()[:] == (5, "+-0.5%")
    errors = spark.createDataFrame([(1, True), (2, False), (4, True)], "idx int, has_error boolean")
    assert R.next_error(errors, 1).first().idx == 4 and R.next_error(errors, 4).first().idx is None
    assert re.search(T.term_pattern("C#").replace("(?iu)", "(?i)").replace(r"\p{L}\p{N}_", r"\w"), "my c#, x") and T.term_pattern("ab").startswith("(?iu)")
    prompt = R.prompts(spark.createDataFrame([("A", "x"), ("A", "w"), ("B", "y")], "label string, term string"), spark.createDataFrame([("t", "[]")], "text string, entities string"), spark.createDataFrame([("z",)], "term string")).first().prompt
    assert "A: w, x\nB: y" in prompt and "Do not use: z" in prompt
    like = spark.createDataFrame([], "section string, name string, tp long")
    assert M.skipped("benchmark", like).first()[:] == ("SKIPPED", "benchmark", None)


def test_logs_settings_and_exports(spark, tmp_path):
    ent = "doc_id long, start int, end int, term string, category string, confidence double, source string, status string"
    ml = spark.createDataFrame([(1, 0, 3, "cat", "A", 0.9, "ML", "ACCEPTED")], ent)
    dic = spark.createDataFrame([(1, 0, 3, "cat", "B", 1.0, "dictionary", "ACCEPTED")], ent)
    docs = spark.createDataFrame([(1, "cat here"), (2, " "), (3, "no")], "doc_id long, text string")
    found, events = resolve_conflicts(ml, dic)
    log = with_sentences(events, docs)
    writers.append_events(log, str(tmp_path / "log"), str(tmp_path / "own"))
    assert [spark.read.json(str(tmp_path / n)).first().sentence for n in ("log", "own")] == ["cat here"] * 2
    terms = spark.createDataFrame([("cat", "IT_TERM", 1)], "term string, label string, ord int")
    rows = {r.doc_id: (r.error, r.occurrences) for r in batch_run(docs, None, terms).collect()}
    assert rows == {1: (None, 1), 2: ("blank", None), 3: (None, 0)}
    answers = {r.doc_id: json.loads(r.response) for r in responses(docs, found).collect()}
    assert answers[1]["entity_count"] == 1 and answers[1]["success"] and not answers[2]["success"] and answers[3]["entities"] == []
    out = writers.export_records(docs, found, found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    assert {r.doc_id: (len(r.entities), r.summary and r.summary.n) for r in out.collect()} == {1: (1, 1), 2: (0, None), 3: (0, None)}
    writers.save_settings(spark, str(tmp_path / "x"), terms, {"mode": "hybrid"})
    assert readers.load_settings(spark, str(tmp_path / "x"))[1] == {"mode": "hybrid"} and readers.load_settings(spark, str(tmp_path / "x"))[0].count() == 1
    items = spark.createDataFrame([("t", [("correct",)]), ("u", [("false_negative",)])], "text string, entity_results array<struct<status:string>>")
    writers.write_evaluation(items, writers.run_path(str(tmp_path), "evals", "m1"))
    got = readers.read_evaluations(spark, str(tmp_path / "evals"), "text string")
    assert sorted((r.text, r.model, r.scope) for r in got.collect()) == [("t", "m1", "all"), ("u", "m1", "all"), ("u", "m1", "errors")]
    assert readers.only_new(docs, docs.where("doc_id < 3"), ["doc_id"]).count() == 1
    (tmp_path / "one.jsonl").write_text("\n" + "\n".join(json.dumps({"text": f"line {i}"}) for i in range(50)))
    assert readers.read_single(spark, str(tmp_path / "one.jsonl")).first().text == "line 0"
    assert json.loads(json.loads(writers.report_document(docs.where("doc_id = 3")).first().report)[0])["text"] == "no"


def slow_fill(sizes, most):
    have, out = [0, 0], []
    for n in sizes:
        if have[0] + n <= most[0] or (have[1] >= most[1] and have[0] < most[0]):
            have[0], k = have[0] + n, "train"
        elif have[1] + n <= most[1]:
            have[1], k = have[1] + n, "dev"
        else:
            k = "test"
        out.append(k)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_split_deals_as_a_fold_does(spark, seed):
    rnd, rows, n = random.Random(seed), [], 0
    for c in range(500):
        for _ in range(1 if rnd.random() < 0.9 else rnd.randrange(2, 30 * seed)):
            rows.append((n, f"Sentence of {c}. Own {n}."))
            n += 1
    got = P.component_split(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), "doc_id", seed=seed).collect()
    import hashlib

    sizes = {}
    for r in got:
        sizes[r.component] = sizes.get(r.component, 0) + 1
    order = sorted(sizes, key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
    want = dict(zip(order, slow_fill([sizes[c] for c in order], (int(n * 0.7), int(n * 0.15))), strict=True))
    assert len(got) == n and all(r.split == want[r.component] for r in got) and len(set(want.values())) == 3


def test_near_duplicate_sentences_against_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("red blue green fast slow cat dog bird tree house".split()) for _ in range(8)) for _ in range(15)]
    left = [(i, t if i % 3 else t.replace("cat", "cot")) for i, t in enumerate(base * 2)]
    right = list(enumerate(base[:8] + ["lone"]))
    got = {r.a: (r.b, round(r.ratio, 9)) for r in S.word_then_ratio(spark.createDataFrame(left, "a int, text string"), spark.createDataFrame(right, "b int, text string"), "a", "b").collect()}
    want = {}
    for i, t in left:
        for j, u in right:
            x, y = set(t.split()), set(u.split())
            ratio = difflib.SequenceMatcher(None, t, u).ratio()
            if len(x & y) / len(x | y) >= 0.6 and ratio >= 0.7 and i not in want:
                want[i] = (j, round(ratio, 9))
    assert got == want and len(want) > 8
