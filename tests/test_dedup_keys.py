import json

import pytest
from pyspark.sql import functions as F
from spanloom.functions import text as T
from spanloom.operators import dedup as D
from spanloom.operators import leakage, synth


def test_null_parts_of_a_key_keep_their_place(spark):
    spans = spark.createDataFrame([(1, None, 5, "a"), (1, 5, None, "b"), (1, 5, None, "c"), (None, 5, 5, "d"), (1, 5, 5, "e"), (1, 5, 5, "f")], "doc_id long, start int, `end` int, o string")
    assert sorted(r.o for r in D.deduplicate_spans(spans, "o").collect()) == ["a", "b", "d", "e"]
    rows = spark.createDataFrame([("a", None, 1), (None, "a", 2), ("a", None, 3), (None, None, 4), ("a", "a", 5)], "text string, false_positive_term string, o int")
    assert sorted(r.o for r in D.deduplicate_negatives(rows, "o").collect()) == [1, 2, 4, 5]
    for limit in (1_000_000, 0):
        assert sorted(r.o for r in D.first_by(rows, ["text", "false_positive_term"], "o", limit).collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_ties_and_null_orders_leave_one_row(spark, limit):
    rows = [(None, "a", 1), (None, "a", 2), (1, "b", 3), (1, "b", 4), (2, "b", 5), (None, "c", 6), (7, "c", 7), (7, "c", 8), (8, None, 9), (8, None, 10), (3, "d", 11)]
    df = spark.createDataFrame(rows, "o int, text string, `_h` int").repartition(3)
    got = D.first_by(df, ["text"], "o", limit)
    assert got.columns == df.columns
    assert sorted((r.text or "", r.o) for r in got.collect()) == [("", 8), ("a", None), ("b", 1), ("c", 7), ("d", 3)]


def test_strip_takes_every_kind_of_white_space(spark):
    every = [chr(c) for c in range(0x3100)]
    df = spark.createDataFrame([(c, c + "x" + c + "y" + c) for c in every], "c string, t string")
    odd = df.where(T.strip("t") != F.regexp_replace("t", f"^{T.SPACE}+|{T.SPACE}+$", "")).collect()
    assert odd == [] and df.where(T.strip("t") == F.concat(F.lit("x"), "c", F.lit("y"))).count() == len(T.SPACES) == 29


def test_exclude_knows_null_from_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "b"), (5, "a")], "id int, `_h` string")
    kept = leakage.exclude(rows, spark.createDataFrame([("a",), (None,), ("",)], "key string"), F.col("_h"))
    assert kept.columns == ["id", "_h"] and sorted(r.id for r in kept.collect()) == [2, 4]


def test_answers_without_records_have_a_reason(spark):
    one = [{"text": "a", "entities": []}]
    answers = [(1, "[" * 200_000), (2, f"Skipped: []. Records: {json.dumps(one)}"), (3, f"[1, 2] {{}} then {json.dumps({'records': one})}"), (4, "nothing [ here"), (5, None), (6, " \n"), (7, "[] {}"), (8, json.dumps(one)), (9, '{"text": "t", "entities": ' + json.dumps("[" * 100_000 + "]") + "}")]
    df = spark.createDataFrame(answers, "response_id int, raw string")
    assert {r.response_id: r.text for r in synth.parse_responses(df).collect()} == {2: "a", 3: "a", 8: "a", 9: "t"}
    assert {r.response_id: r.reason for r in synth.failed_responses(df).collect()} == {1: "too_deep", 4: "no_json", 5: "empty", 6: "empty", 7: "no_records"}
