"""Many languages, hot texts in samples, clashing column names, labels of other types, recall end to end, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import bpe, embed_dedup, exact_dedup, langid, mixing, near_dedup, quality, samples, secrets, substring_dedup, toxicity
from spanloom.llm.common import Scratch


def test_more_than_256_languages():
    rnd, n = np.random.default_rng(1), 300
    e = rnd.normal(size=(40, n)).astype(np.float32)
    e[:20, 280] += 9
    e[20:, 24] += 9
    assert langid.viterbi(e, np.array([0, 40]), 2.0).tolist() == [280] * 20 + [24] * 20


def test_a_language_of_one_text_is_learnt(spark):
    rows = [(i, "the same english words again and again", "en") for i in range(3000)] + [(5000 + i, f"der hund und die katze {i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, F.lit(True), per_lang=40).langs == ["de", "en"]


def test_samples_keep_each_class(spark):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(400)], "doc_id long, toxic int")
    take = lambda per, chars: samples.labelled_sample(docs, labels, "toxic", F.lit(True), per, chars, [], Scratch(spark, "t")).groupBy("y").count().collect()
    assert {r.y for r in take(1, 10)} == {0, 1} and {r.y: r["count"] for r in take(1000, 10**9)} == {0: 395, 1: 5}
    assert all(r["count"] < 60 for r in take(1000, 10_000))


NAMES = ["_near_id", "_lost_id", "_text_sha", "_mix_text", "_k1", "_k2", "_hit", "_word", "_bits", "_twin", "_sha", "_hash", "_list", "_gone0", "n_tokens", "text_", "a.b", "h", "th", "comp"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, None, None), (None, "other words here", "s"), (None, "free", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])


def test_names_of_users_stay(spark, clashing):
    own = lambda df: [tuple(r[3:]) for r in df.collect()]
    want = tuple(range(len(NAMES)))
    for limit in (1_000_000, 0):
        out = exact_dedup.exact_dedup(clashing, max_broadcast=limit)
        assert out.columns == clashing.columns and set(own(out)) == {want} and sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 2, 3]
    near = near_dedup.keep_first(clashing, Scratch(spark, "t"))
    assert near.columns == clashing.columns and set(own(near)) == {want} and sorted(r.doc_id or 0 for r in near.collect()) == [0, 0, 1, 3]
    mixed = mixing.Mix(clashing).documents()
    assert mixed.columns == clashing.columns and set(own(mixed)) == {want}
    coded = bpe.encode_decode(clashing, ["doc_id", "a.b", "n_tokens"])
    assert coded.columns == ["doc_id", "a.b", "n_tokens", "ids", "decoded"] and coded.where("n_tokens = 14").count() == 6


def test_empty_tables(spark, clashing):
    empty = clashing.limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = langid.train(empty, F.lit(True), lang_col="source")
    assert langid.identify(empty, model, [F.col("doc_id")]).count() == bpe.encode_decode(empty, ["doc_id"]).count() == 0
    assert quality.score(empty, quality.train(empty, labels, F.lit(True), chars_col=None), [F.col("doc_id")], chars_col=None).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels, F.lit(True)), [F.col("doc_id")]).count() == 0
    assert secrets.find_secrets(empty).count() == substring_dedup.remove_repeats(empty, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("dim", [8, 64, 384])
def test_recall_end_to_end(spark, dim):
    rnd = np.random.default_rng(dim)
    x = rnd.normal(size=(250, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9305 * x + (1 - 0.9305**2) ** 0.5 * z
    v = np.concatenate([x, y])
    labels = ["1.2" if i % 2 else "1.7" for i in range(250)] * 2
    df = spark.createDataFrame([(i, row.tolist(), g) for i, (row, g) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<double>, label string")
    near = (v @ v.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(v), dtype=bool)
    found = sum(r.n_links for r in embed_dedup.near_vectors(df, Scratch(spark, "t")).collect())
    assert near.sum() >= 480 and 0.9 * near.sum() <= found <= near.sum(), (found, near.sum())
