"""Jobs that read what they need once and shuffle no tokens."""

import hashlib

from spanloom.operators import edit
from spanloom.operators.tokens import rule_token_table, whole_texts
from spanloom.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_rule_tokens_whole_shuffles_no_tokens(spark):
    assert "Exchange" not in registry.QUERIES["rule_tokens_whole"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_whole_texts_over_many_batches(spark):
    texts = ["", None, "one", "Dr. Müller can't  go.\n" * 5, "é", "a b " * 9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        got = {r.doc_id: (r.text_sha256, r.n_chars) for r in whole_texts(rule_token_table(docs)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), len(t)) for i, t in enumerate(texts) if t}


def test_sync_reads_places_once(spark, monkeypatch):
    seen, own = spark.sparkContext.accumulator(0), edit.match_terms

    def counted(*args):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        found = own(*args)
        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(edit, "match_terms", counted)
    docs = spark.createDataFrame([(1, "ab ab ab cd ab")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2, "X"), (1, 3, 5, "Y"), (1, 5, 8, "Y")], "doc_id long, start int, end int, label string")
    terms = spark.createDataFrame([("ab", "X")], "term string, label string")
    changes = edit.sync_terms(docs, spans, terms)[1]
    assert sorted((r.start, r.action) for r in changes.collect()) == [(0, "same"), (3, "relabelled"), (6, "skipped"), (12, "added")]
    assert seen.value == 4
