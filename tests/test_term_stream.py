"""Counts of terms over a stream: the same as over the whole table, in whatever batches the rows come."""

import random
import time

from spanloom.sources import batches as B
from spanloom.streaming import terms as T

KIND = "term string, label string, doc string, start long, kind string"


def run(spark, folder, name, ttl_ms=3_600_000):
    rows = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    q = T.count_stream(rows, f"{folder}/{name}-out", f"{folder}/{name}-ck", ttl_ms)
    assert q.awaitTermination(150) and q.exception() is None
    return {tuple(r) for r in T.latest(B.read_batches(spark, f"{folder}/{name}-out")).select("term", "label", "found", "overruled", "documents").collect()}


def test_stream_equals_batch_over_shuffled_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["tax", "office", "ünï"]), rnd.choice("AB"), str(rnd.randrange(12)), rnd.randrange(6), rnd.choice([T.FOUND, T.OVERRULED])) for _ in range(160)]
    rows += rows[:30]  # told twice
    want = {tuple(r) for r in T.term_counts(spark.createDataFrame(rows, KIND)).select("term", "label", "found", "overruled", "documents").collect()}
    places = set(rows)
    assert want == {(t, x, sum(p[:2] == (t, x) and p[4] == T.FOUND for p in places), sum(p[:2] == (t, x) and p[4] == T.OVERRULED for p in places), len({p[2] for p in places if p[:2] == (t, x)})) for t, x in {p[:2] for p in places}}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rnd.shuffle(rows)
        for at in range(0, len(rows), 95):
            spark.createDataFrame(rows[at : at + 95], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        assert run(spark, tmp_path, "a") == want
        assert run(spark, tmp_path, "a") == want  # nothing new
        spark.createDataFrame(rows[:50], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        assert run(spark, tmp_path, "a") == want  # restarted from its checkpoint; all known
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_what_is_not_met_is_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        row = spark.createDataFrame([("tax", "A", "1", 0, T.FOUND)], KIND).coalesce(1)
        row.write.mode("append").parquet(f"{tmp_path}/b")
        assert run(spark, tmp_path, "b", 1000) == {("tax", "A", 1, 0, 1)}
        time.sleep(1.5)
        row.write.mode("append").parquet(f"{tmp_path}/b")
        assert run(spark, tmp_path, "b", 1000) == {("tax", "A", 1, 0, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_happenings(spark):
    e = spark.createDataFrame([(1, 0, "Tax", "A"), (1, 9, "", "A"), (2, 3, None, "A"), (3, 4, "tax", None)], "doc_id int, start int, term string, category string")
    v = spark.createDataFrame([(1, 0, "Tax", "B")], "doc_id int, start int, term string, ml_label string")
    got = {tuple(r) for r in T.happenings(e, v).select("term", "label", "doc", "start", "kind").collect()}
    assert got == {("tax", "A", "1", 0, T.FOUND), ("tax", "", "3", 4, T.FOUND), ("tax", "B", "1", 0, T.OVERRULED)}
