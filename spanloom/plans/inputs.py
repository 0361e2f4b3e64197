"""Inputs that the queries derive from the driver tables, the same in Spark and in SQL.

The corpora are invented prose, so the dictionary is made of their most frequent words and word pairs, and model
and gold spans are placed by arithmetic on document and token numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators.dictionary import dealt_out, token_rows
from ..operators.scratch import Scratch
from ..sources.tables import table

TOK_SQL = f"""
tk0 AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents),
tk1 AS (SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS idx FROM tk0),
tok AS MATERIALIZED (SELECT doc_id, idx, tok, CAST(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY idx) - length(tok) AS BIGINT) AS start FROM tk1)"""

TERMS_SQL = """
tw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4) AS w FROM documents WHERE lang = 'en'),
t1 AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM tw) GROUP BY term ORDER BY df DESC, term LIMIT 40),
t2 AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw) GROUP BY term ORDER BY df DESC, term LIMIT 20),
t3 AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM t1 UNION ALL SELECT term, 40 + row_number() OVER (ORDER BY df DESC, term) FROM t2),
terms AS (SELECT term, CASE WHEN r % 2 = 1 THEN 'IT_TERM' ELSE 'CLERICAL_TERM' END AS label, row_number() OVER (ORDER BY length(term) DESC, r) AS ord FROM t3)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, label, ord): the 40 most frequent English words of four letters or more and their 20 most frequent pairs.

    The table is written once a call, since operators read a dictionary more than once.
    """
    w = dealt_out(docs(spark, d).where("lang = 'en'").select("doc_id", "text")).select(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4).alias("w"))
    pairs = F.when(F.size("w") >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))).otherwise(F.array().cast("array<string>"))

    def top(array, n: int, base: int) -> DataFrame:
        best = w.select(F.explode(array).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(n)
        return best.select("term", (F.lit(base) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "term"))).alias("r"))

    both = top(F.array_distinct("w"), 40, 0).unionByName(top(pairs, 20, 40))
    label = F.when(F.col("r") % 2 == 1, "IT_TERM").otherwise("CLERICAL_TERM")
    return Scratch(spark, "terms").save(both.select("term", label.alias("label"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.length("term").desc(), "r")).alias("ord")))


PAIRS_SQL = r"""
wp0 AS (SELECT doc_id, idx, tok, start, lead(tok, 1) OVER w AS gap, lead(tok, 2) OVER w AS second FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
wp AS MATERIALIZED (SELECT doc_id, idx, tok, second, start, start + length(tok) + 1 + length(second) AS end_, tok || ' ' || second AS term
       FROM wp0 WHERE gap = ' ' AND regexp_full_match(tok, '[\p{L}\p{N}_]+') AND regexp_full_match(second, '[\p{L}\p{N}_]+')),
ml AS MATERIALIZED (SELECT doc_id, idx, start, end_, term, CASE WHEN (doc_id + idx) % 2 = 0 THEN 'IT_TERM' ELSE 'CLERICAL_TERM' END AS category,
              0.5 + ((31 * doc_id + idx) % 50) / 100.0::DOUBLE AS confidence FROM wp WHERE (doc_id + idx) % 17 = 0),
gold AS MATERIALIZED (SELECT doc_id, idx, start, CASE WHEN idx % 5 = 0 THEN start + length(tok) ELSE end_ END AS end_,
                CASE WHEN idx % 5 = 0 THEN tok ELSE term END AS term, CASE WHEN (doc_id + idx) % 4 < 2 THEN 'IT_TERM' ELSE 'CLERICAL_TERM' END AS label
         FROM wp WHERE (doc_id + idx) % 34 = 0 OR (doc_id + idx) % 51 < 2)"""


def _marked(doc_id, idx):
    """Whether a token's numbers let it begin a model or a gold span, for columns or arrays; the remainder has the sign of the sum, as in SQL."""
    n = np.fmod(doc_id + idx, 102)
    return (np.fmod(n, 17) == 0) | (np.fmod(n, 51) < 2)


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, idx, tok, second, start, end, term): two words with one space between, where a model or a gold span may begin."""
    t = token_rows(dealt_out(docs(spark, d).select("doc_id", "text")), after=2, pick=_marked).withColumnsRenamed({"after1": "gap", "after2": "second"})
    word = r"^[\p{L}\p{N}_]+$"
    t = t.where((F.col("gap") == " ") & F.col("tok").rlike(word) & F.col("second").rlike(word))
    return t.withColumn("end", F.col("start") + F.length("tok") + 1 + F.length("second")).withColumn("term", F.concat_ws(" ", "tok", "second")).drop("gap")


def ml_spans(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """Stand-in for a model's predictions: (doc_id, idx, start, end, term, category, confidence); pairs: word_pairs that are there already."""
    p = (pairs or word_pairs(spark, d)).where("(doc_id + idx) % 17 = 0")
    category = F.when((F.col("doc_id") + F.col("idx")) % 2 == 0, "IT_TERM").otherwise("CLERICAL_TERM")
    return p.select("doc_id", "idx", "start", "end", "term", category.alias("category"), (F.lit(0.5) + ((31 * F.col("doc_id") + F.col("idx")) % 50) / F.lit(100.0)).alias("confidence"))


def gold_spans(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """Stand-in for annotations: (doc_id, idx, start, end, term, label); pairs: word_pairs that are there already."""
    p = (pairs or word_pairs(spark, d)).where("(doc_id + idx) % 34 = 0 or (doc_id + idx) % 51 < 2")
    short = F.col("idx") % 5 == 0
    label = F.when((F.col("doc_id") + F.col("idx")) % 4 < 2, "IT_TERM").otherwise("CLERICAL_TERM")
    return p.select("doc_id", "idx", "start", F.when(short, F.col("start") + F.length("tok")).otherwise(F.col("end")).alias("end"), F.when(short, F.col("tok")).otherwise(F.col("term")).alias("term"), label.alias("label"))


def stored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """word_pairs written once, for queries that read model and gold spans more than once."""
    return Scratch(spark, "pairs").save(word_pairs(spark, d))
