"""Queries over sources and sinks: tables written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..sources import batches as B
from ..sources import jsonl as J
from ..sources.tables import table
from .inputs import docs

QUERIES, ORACLE_SQL = {}, {}


def turns_as_lines(spark, d):
    """All turns as JSON lines in a folder: some cut short, some without a text, each text file with comments and blank lines."""
    t = table(spark, d, "conversations")
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.left(whole, F.length(whole) - 1)).when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.to_json(F.struct("conv_id", "turn", "role"))).otherwise(whole)
    folder = Scratch(spark, "lines").root
    t.select(F.explode(F.array(line, F.lit("# turn"), F.lit(""))).alias("value")).write.text(folder)
    return folder


def jsonl_validated(spark, d):
    rows = J.numbered(spark, turns_as_lines(spark, d), range_bytes=1 << 20)
    r = rows.select(F.from_json("value", "conv_id long, turn long, role string, text string").alias("r"), F.regexp_replace("error", ":.*", "").alias("error"), (F.col("line") % 3).alias("line_mod_3"))
    ok = F.coalesce(F.col("error"), F.lit("")) != "malformed JSON"
    return r.select(*[F.when(ok, F.col(f"r.{c}")).alias(c) for c in ("conv_id", "turn", "role", "text")], "error", "line_mod_3")


QUERIES["jsonl_validated"] = jsonl_validated
ORACLE_SQL["jsonl_validated"] = """SELECT CASE WHEN e <> 'malformed JSON' THEN conv_id::BIGINT END AS conv_id, CASE WHEN e <> 'malformed JSON' THEN turn::BIGINT END AS turn, CASE WHEN e <> 'malformed JSON' THEN role END AS role,
CASE WHEN e = '' THEN text END AS text, nullif(e, '') AS error, 1::BIGINT AS line_mod_3
FROM (SELECT *, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'malformed JSON' WHEN (conv_id + turn) % 13 = 0 OR text IS NULL THEN 'no text' ELSE '' END AS e FROM conversations)"""


def batches_once(spark, d):
    """Documents in three batches, one of which is repeated and one tried before by an attempt that did not end."""
    path = Scratch(spark, "batches").root
    rows = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.pmod("doc_id", F.lit(3)).alias("part"))
    rows.where("part <> 1").write.parquet(f"{path}/data/run=all/batch=1")
    for n in (0, 1, 2, 0):
        B.write_batch(rows.where(F.col("part") == n), path, "all", n)
    return B.read_batches(spark, path).select("doc_id", "text_sha256", "run", "batch")


QUERIES["batches_once"] = batches_once
ORACLE_SQL["batches_once"] = "SELECT doc_id, sha256(text) AS text_sha256, 'all' AS run, doc_id % 3 AS batch FROM documents"
