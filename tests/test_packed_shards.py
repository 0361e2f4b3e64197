"""Cross-validation keeps each text once, in shards that all models read, and gives what training and counting apart give."""

import os
import random
import time

from pyspark.sql import functions as F
from spanloom.operators import provider as V
from spanloom.operators import tagger as G
from spanloom.operators.metrics import strict_counts
from spanloom.operators.scratch import Scratch

LABELS = ("A", "B")


def corpus(spark, n, words):
    rnd = random.Random(n)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "on", "ur")]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice((1, 2, 2, 3))))
    docs, gold = [], []
    for i in range(n):
        text = ""
        for _ in range(words):
            kind = rnd.choice("ABxxxxxx")
            w = {"A": "Visual Basic", "B": "Paper,", "x": word() + rnd.choice(["", "", ",", "."])}[kind]
            if kind != "x":
                gold.append((i, len(text), len(text) + (12 if kind == "A" else 5), kind))
            text += w + rnd.choice([" ", " ", " ", "  ", "\n"])
        docs.append((i, text))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(gold, "doc_id long, start int, `end` int, label string"), docs


def test_counts_equal_taggers_one_by_one(spark, tmp_path):
    docs, gold, plain = corpus(spark, 30, 25)
    more = [(3, "Paper, lone Visual Basic"), (3, "Paper, lone Visual Basic"), (40, None), (41, ""), (None, "Paper,"), (42, "Paper, without a fold")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    odd = [(3, 0, 5, "B"), (3, 0, 5, "B"), (4, 1, 7, "A"), (5, 0, 3, "other"), (41, 0, 4, "A"), (42, 0, 5, "B"), (99, 0, 5, "B"), (6, 0, 90_000, "A")]
    gold = gold.unionByName(spark.createDataFrame(odd, gold.schema))
    folds = spark.createDataFrame([(i, i % 3) for i in [*range(30), 40, 41]], "doc_id long, fold int")
    s = Scratch(spark, "t")
    lowered = V.some_lowered(0.5)
    conditions = {"real": docs, "lowered": V.lower_some(docs, 0.5)}
    want = set()
    for c, train in conditions.items():
        for f in range(3):
            model = G.train(train.join(folds.where(F.col("fold") != f), "doc_id").drop("fold"), gold, LABELS, s, epochs=2)
            own = docs.join(folds.where(F.col("fold") == f), "doc_id").drop("fold")
            found = G.predict(own, model, s).select("doc_id", "start", "end", F.col("category").alias("label"))
            want |= {(c, f, *r) for r in strict_counts(gold.join(own.select("doc_id").distinct(), "doc_id"), found).collect()}
    assert len({r[2] for r in want}) == 3
    for k, second in enumerate((conditions["lowered"], lowered)):
        got = G.cross_validate({"real": docs, "lowered": second}, gold, folds, LABELS, str(tmp_path / f"cv{k}"), s, epochs=2)
        assert set(map(tuple, got.collect())) == want


def test_many_shards_repeat_and_learn(spark, tmp_path):
    docs, gold, _ = corpus(spark, 60, 40)
    folds = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("fold"))
    s = Scratch(spark, "t")
    got = [sorted(map(tuple, G.cross_validate({"real": d}, g, folds, LABELS, str(tmp_path / f"cv{k}"), s, epochs=3, shard_tokens=300).collect())) for k, (d, g) in enumerate([(docs, gold), (docs.repartition(7), gold.repartition(5, "start"))])]
    assert got[0] == got[1] and all(tp > 20 * (fp + fn + 1) / 10 for *_, tp, fp, fn in got[0])


def test_what_is_stored_is_about_as_large_as_the_texts(spark, tmp_path, monkeypatch):
    docs, gold, plain = corpus(spark, 120, 900)
    folds = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("fold"))
    s, sizes, save = Scratch(spark, "t"), {}, Scratch.save

    def kept(self, df, name="t"):
        out = save(self, df, name)
        path = out._scratch_path.removeprefix("file://")
        sizes[path] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
        return out

    monkeypatch.setattr(Scratch, "save", kept)
    G.cross_validate({"real": docs, "lowered": V.lower_some(docs)}, gold, folds, LABELS, str(tmp_path / "cv"), s, epochs=1).collect()
    assert sum(v for k, v in sizes.items() if not k.endswith("weights")) < 2 * sum(len(t) for _, t in plain), sizes


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    out = Scratch(spark, "t").save(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
