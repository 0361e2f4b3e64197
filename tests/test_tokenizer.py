"""The rule tokenizer against a hand table, and what it never may do: lose a character, or give out on long texts."""

import pytest
from pyspark.sql import functions as F
from spanloom.functions import tokenizer as T
from spanloom.operators import dictionary as D
from spanloom.operators.tokens import rule_token_table

TABLE = [
    ("I don't, can't and won’t.", "I|do|n't|,|ca|n't|and|wo|n’t|."),
    ("DON'T they're she'll I'm we've he'd", "DO|N'T|they|'re|she|'ll|I|'m|we|'ve|he|'d"),
    ("the boss's dogs' bones", "the|boss|'s|dogs|'|bones"),
    ("You cannot. Cannot! canNOT cannots", "You|can|not|.|Can|not|!|can|NOT|cannots"),
    ("gonna go at five o'clock, ma'am; y'all 'tis", "gon|na|go|at|five|o'clock|,|ma'am|;|y'|all|'t|is"),
    ("See https://a.example/x?y=1&z=(2), or www.b.example.", "See|https://a.example/x?y=1&z=(2|)|,|or|www.b.example|."),
    ("Mail first.last+tag@mail.example.org.", "Mail|first.last+tag@mail.example.org|."),
    ("Dr. Who, e.g. Inc. vs. Mr. X et al. and etc.", "Dr.|Who|,|e.g.|Inc.|vs.|Mr.|X|et al.|and|etc."),
    ("The U.S. and U.K.s", "The|U.S.|and|U|.|K|.|s"),
    ("1,234.50 at 10:30, 3.", "1,234.50|at|10:30|,|3|."),
    ("10km 5 kg 3D h2o 7pm 4th", "10|km|5|kg|3D|h2o|7|pm|4th"),
    ('("well-known", [and/or])', '(|"|well|-|known|"|,|[|and|/|or|]|)'),
    ("wait... what -- no…", "wait|...|what|--|no|…"),
    ("𝒳 😀😀 naïve naïve", "𝒳|😀|😀|naïve|naïve"),
    ("snake_case a.b x's'", "snake_case|a|.|b|x|'s|'"),
    ("n't 's don'ts", "n|'|t|'|s|don|'|ts"),
]


def test_hand_table(spark):
    rows = spark.createDataFrame(TABLE, "text string, want string").select("*", T.rule_tokens("text").alias("t")).collect()
    got = {r.text: "|".join(x for x in r.t if x.strip()) for r in rows}
    assert got == dict(TABLE)
    assert all("".join(r.t) == r.text for r in rows)


def test_rules_are_parameters(spark):
    own = T.Rules(abbreviations=["z.B."], parts={"zum": ("zu", "m")}, endings=[], units=[])
    none = T.Rules(abbreviations=[], parts={}, endings=[], units=[])
    row = spark.createDataFrame([("z.B. zum 5km it's",)], "t string").select(T.rule_tokens("t", own).alias("a"), T.rule_tokens("t", none).alias("b"), T.rule_tokens(F.lit(None).cast("string")).alias("c")).first()
    assert "|".join(x for x in row.a if x != " ") == "z.B.|zu|m|5km|it|'|s" and "|".join(x for x in row.b if x != " ") == "z.B.|zum|5km|it|'|s" and row.c is None
    with pytest.raises(ValueError):
        T.Rules(parts={"ab": ("a", "c")})


def test_long_and_odd_texts_come_back_whole(spark):
    n = 200_000
    texts = ["a." * n, "1," * n, "1" * n, "x" * n, "." * n, "-" * n, " " * n, "'s" * n, "n't" * n, "www." + "a." * n, "a@" * 20_000, "don't " * n, "\x00 ﻿\r\ń", "", "é" * n]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    t = rule_token_table(docs)
    got = {r.doc_id: r for r in t.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tok"))), lambda x: x.tok), ""), 256).alias("sha"), F.max(F.col("start") + F.length("tok")).alias("n")).collect()}
    want = {r.doc_id: (r.sha, r.n) for r in docs.where("length(text) > 0").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n")).collect()}
    assert {k: (r.sha, r.n) for k, r in got.items()} == want


def test_offsets_and_alignment(spark):
    text = "😀 He didn't pay 10km, e.g. to a@b.example."
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    toks = rule_token_table(docs)
    rows = sorted((r.doc_id, r.idx, r.tok, r.start) for r in toks.collect())
    assert [i for d, i, *_ in rows if d == 1] == list(range(sum(d == 1 for d, *_ in rows))) and all((text if d == 1 else "a b")[s : s + len(t)] == t for d, _, t, s in rows)
    at = text.index("dn't")
    spans = spark.createDataFrame([(1, at, at + 6), (1, text.index("km") - 1, text.index("km") + 2)], "doc_id long, start int, end int")
    for mode, want in (("contract", {"n't", "km"}), ("expand", {"n't", "km"})):
        got = D.align_spans(toks, spans, mode=mode).collect()
        assert {text[r.start : r.end] for r in got} == want
    wide = spark.createDataFrame([(1, text.index("b.ex"), text.index("b.ex") + 3)], "doc_id long, start int, end int")
    assert D.align_spans(toks, wide).count() == 0 and [text[r.start : r.end] for r in D.align_spans(toks, wide, mode="expand").collect()] == ["a@b.example"]
