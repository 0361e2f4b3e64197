import numpy as np
from spanloom.llm import langid
from spanloom.llm.common import crc_mod
from pyspark.sql import functions as F

EN = "the cat and the dog went out with another brother there this that whether thing"
DE = "der hund und die katze ging zur schule nicht auch einmal schön größe zwischen"
RU = "это просто русский текст про кошку собаку"


def slow_viterbi(e, switch):
    n, k = e.shape
    best = []
    v, back = e[0], []
    for t in range(1, n):
        step = [[v[a] - (switch if a != b else 0) for a in range(k)] for b in range(k)]
        back.append([int(np.argmax(s)) for s in step])
        v = np.array([max(s) for s in step]) + e[t]
    best = [int(np.argmax(v))]
    for b in reversed(back):
        best.append(b[best[-1]])
    return best[::-1]


def test_viterbi_is_optimal_for_every_text():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        sizes = rnd.integers(0, 9, rnd.integers(1, 7))
        bound = np.concatenate([[0], np.cumsum(sizes)])
        e = rnd.normal(size=(bound[-1], 3)).astype(np.float32)
        got = langid.viterbi(e, bound, 0.7)
        for a, b in zip(bound, bound[1:]):
            if a < b:
                assert got[a:b].tolist() == slow_viterbi(e[a:b], 0.7)


def docs(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "clash") for i in range(60)] + [(i, RU, "ru", "") for i in range(60, 90)]
    rows += [(None, None, "en", None), (100, "", None, None), (101, "123 !!", "en", None), (102, EN + " " + DE, None, None), (103, (EN + " ") * 3000, None, None), (104, "ελλάδα", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages_spans_and_edges(spark):
    df = docs(spark)
    model = langid.train(df, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r for r in langid.identify(df, model, [F.col("doc_id")]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and all(got[i].lang_pred == "ru" for i in range(60, 90))
    assert got[None].lang_pred == got[100].lang_pred == got[101].lang_pred == "und" and got[101].score == 0 and got[101].spans == []
    assert [s.lang for s in got[102].spans] == ["en", "de"] and got[102].spans[1].start in (len(EN) + 1, len(EN) + 5)
    assert got[103].lang_pred == "en" and got[103].score > 0.95
    assert got[104].lang_pred in ("de", "en", "ru")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    df = docs(spark)
    model = langid.train(df, F.lit(False))
    assert {r.lang_pred for r in langid.identify(df, model, [F.col("doc_id")]).collect()} == {"und"}
