import random

import corpus_pipeline
import numpy as np
from spanloom.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, id string"


def test_stages_and_run(spark, tmp_path):
    rnd = random.Random(6)
    word = {"en": "the and that with this from have will your".split(), "de": "der und nicht mit auch sich eine wird durch".split()}
    rows = []
    for i in range(240):
        lang = "de" if i % 4 == 0 else "en"
        text = " ".join(rnd.choice(word[lang]) + rnd.choice(["", "", "er", "ing" if lang == "en" else "ung"]) for _ in range(rnd.randrange(30, 90)))
        rows.append([i, text, lang, f"s{i % 3}", len(text), "a", None, "b"])
    rows[10][1] = rows[11][1] = rows[12][1]
    rows[20][1] = rows[21][1] + " tail"
    rows += [[300, "12 34 !!", "en", "s0", 8, "", "", ""], [301, *[None] * 7], [302, "", "en", "s1", 0, "", "", ""]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert seen["language_id"] == set(range(240))
    assert seen["exact_dedup"] == set(range(240)) - {10, 11}
    assert 21 not in seen["near_dedup"] and seen["near_dedup"] >= set(range(240)) - {10, 11, 20, 21}
    path, pattern = bpe.default_vocabulary()
    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    mixed = {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "mix_sources")).collect()}
    for r in docs.collect():
        assert (r.doc_id, r.text) in mixed and codec.encode([r.text])[0] == bytes(r.token_ids) and r.n_tokens == len(np.frombuffer(bytes(r.token_ids), "<u4"))
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))
