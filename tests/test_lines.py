"""JSON lines by byte ranges, and the sink whose batches can be repeated."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from spanloom.sources import batches as B
from spanloom.sources import jsonl as J

GOOD = ['{"text": "one"}', '{"text": "Ünï – 𝒳", "entities": []}', '{"text": "' + "long " * 300 + '"}']
BAD = ['{"text": ', "[1]", '{"txt": "a"}', '{"text": "a", "entities": {}}', "[" * 100_000]
SKIPPED = ["", "   ", "# a comment"]


def write(path, lines, end="\n", last=True):
    path.write_bytes((end.join(lines) + (end if last else "")).encode())
    return str(path)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_line_once_whatever_the_ranges(spark, tmp_path, size):
    rnd = random.Random(size)
    lines = {}
    for k, (end, last) in enumerate([("\n", True), ("\r\n", False), ("\n", False)]):
        own = [rnd.choice(GOOD + SKIPPED) for _ in range(3 if size == 1 else 40)] + ['{"text": "z"}']
        if size == 1:
            own = [x[:20] for x in own]
        lines[write(tmp_path / f"{k}.jsonl", own, end, last)] = own
    (tmp_path / "_SUCCESS").write_text("x")
    write(tmp_path / "none.jsonl", [], last=False)
    parts = [r for path, n in J.files(str(tmp_path)) for r in J.ranges(path, 0, n, size)]
    source = J.Lines({"path": str(tmp_path), "mode": "lines"})
    got = {}
    for r in parts:
        for b in source.read_range(r):
            for row in b.to_pylist():
                got.setdefault(row["path"], []).append((row["offset"], row["value"]))
    assert {p: [v for _, v in x] for p, x in got.items()} == lines
    for path, rows in got.items():
        assert all(J.line_of(path, o) == k + 1 for k, (o, _) in enumerate(rows))


def test_modes(spark, tmp_path):
    own = [*GOOD, *SKIPPED, *BAD, *GOOD]
    path = write(tmp_path / "a.jsonl", own)
    with open(path, "ab") as f:
        f.write(b'{"text": "\xff"}\n')
    rows = {r.line: r for r in J.numbered(spark, path, range_bytes=300).collect()}
    assert sorted(rows) == [1, 2, 3, *range(7, 7 + len(BAD) + 4)]
    errors = [rows[k].error for k in range(7, 12)]
    assert errors[0].startswith("malformed JSON") and errors[1:4] == ["not an object", "no text", "entities is not a list"] and errors[4] is not None
    assert rows[15].error == "not UTF-8" and all(rows[k].error is None and rows[k].value == own[k - 1] for k in (1, 2, 3, 12, 13, 14))
    kept = J.read_records(spark, path, "text string", "tolerant", range_bytes=300).collect()
    assert sorted(r.text for r in kept) == sorted([json.loads(x)["text"] for x in GOOD] * 2)
    with pytest.raises(PySparkException, match=r"a\.jsonl, line 7: malformed JSON"):
        J.read_lines(spark, path, range_bytes=300).where("n >= 0").collect()
    assert J.read_lines(spark, write(tmp_path / "c", ['{"text": "a"}', "# c"]), "validating", comments=False).where("error is not null").count() == 1
    with pytest.raises(PySparkException, match="mode must be"):
        J.read_lines(spark, path, "fast").collect()
    (tmp_path / "empty").mkdir()
    assert J.read_lines(spark, str(tmp_path / "empty")).count() == 0 and J.numbered(spark, str(tmp_path / "empty")).count() == 0


def test_marks_and_packed_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_bytes(b'\xef\xbb\xbf{"text": "a"}\n')
    assert [r.value for r in J.read_lines(spark, f"file:{tmp_path}/m.jsonl").collect()] == ['{"text": "a"}']
    (tmp_path / "p.gz").write_bytes(b"x")
    with pytest.raises(PySparkException, match="compressed"):
        J.read_lines(spark, str(tmp_path)).collect()


def test_a_stream_reads_what_is_appended(spark, tmp_path):
    J.register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        s = spark.readStream.format(J.NAME).option("mode", "tolerant").option("rangeBytes", 30).load(str(folder))
        q = s.select(F.get_json_object("value", "$.text").alias("text")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted(r.text for r in spark.read.schema("text string").parquet(out).collect())

    (folder / "a").write_text('{"text": "a1"}\nbad\n{"text": "a2"}\n{"text": "a')
    assert run() == ["a1", "a2"]
    with open(folder / "a", "a") as f:
        f.write('3"}\n')
    (folder / "b").write_text('{"text": "b1"}\n')
    assert run() == ["a1", "a2", "a3", "b1"]


def test_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = lambda *k: spark.createDataFrame([(x, f"v{x}") for x in k], "k long, v string")
    assert B.committed(spark, path).count() == 0
    assert B.write_batch(rows(1, 2), path, "001", 0)
    assert not B.write_batch(rows(1, 2), path, "001", 0)  # repeated as a whole
    with pytest.raises(PySparkException):  # killed while it writes
        B.write_batch(rows(3, 4).select("k", F.when(F.col("k") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v")).coalesce(1), path, "001", 1)
    rows(98, 99).write.mode("overwrite").parquet(f"{path}/data/run=001/batch=2")  # killed before its entry
    assert {(r.run, r.batch) for r in B.committed(spark, path).collect()} == {("001", 0)}
    assert sorted(r.k for r in B.read_batches(spark, path).collect()) == [1, 2]
    assert B.write_batch(rows(3, 4), path, "001", 1) and B.write_batch(rows(5).withColumn("more", F.lit(7)), path, "001", 2) and B.write_batch(rows(), path, "001", 3)
    assert B.write_batch(rows(1), path, "1", 0)  # another run
    got = B.read_batches(spark, path, ["001"])
    assert sorted((r.k, r.v, r.more, r.run, r.batch) for r in got.where("more is null").collect()) == [(1, "v1", None, "001", 0), (2, "v2", None, "001", 0), (3, "v3", None, "001", 1), (4, "v4", None, "001", 1)]
    assert [(r.k, r.batch) for r in got.where("more = 7").collect()] == [(5, 2)] and B.read_batches(spark, path).count() == 6
    for bad in (lambda: B.write_batch(rows(1), path, "a/b", 0), lambda: B.write_batch(rows(1).withColumnRenamed("v", "Batch"), path, "a", 0)):
        with pytest.raises(ValueError):
            bad()
