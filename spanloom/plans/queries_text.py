"""Queries over text functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.text import SPACE, TOKEN, WORD_RUN
from .inputs import PAIRS_SQL, TOK_SQL, docs, ml_spans

QUERIES, ORACLE_SQL = {}, {}

STRIP = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
COLLAPSE = f"regexp_replace({STRIP}, '{SPACE}+', ' ', 'g')"


def normalize_keys(spark, d):
    """Lengths and hashes of the four normal forms."""
    x = docs(spark, d)
    forms = {"lower_strip": T.lower_strip("text"), "strip": T.strip("text"), "collapse": T.collapse("text"), "normal": T.normalise("text")}
    return x.select("doc_id", *[F.md5(v.cast("binary")).alias(k) for k, v in forms.items()])


QUERIES["normalize_keys"] = normalize_keys
ORACLE_SQL["normalize_keys"] = f"SELECT doc_id, md5(lower({STRIP})) AS lower_strip, md5({STRIP}) AS strip, md5({COLLAPSE}) AS collapse, md5(lower({COLLAPSE})) AS normal FROM documents"

QUERIES["source_ids"] = lambda spark, d: docs(spark, d).select("doc_id", T.source_id("text").alias("source_id"))
ORACLE_SQL["source_ids"] = f"SELECT doc_id, left(sha256(lower({COLLAPSE})), 16) AS source_id FROM documents"


def token_stats(spark, d):
    chars, words = T.char_word_counts("text")
    t = T.tokens("text")
    return docs(spark, d).select("doc_id", chars.alias("n_chars"), words.alias("n_words"), F.size(t).alias("n_tokens"), (F.array_join(t, "") == F.col("text")).alias("lossless"), T.snippet("text").alias("snippet"), T.snippet("text", 55, always=True).alias("short"))


QUERIES["token_stats"] = token_stats
ORACLE_SQL["token_stats"] = f"""
SELECT doc_id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) AS n_words, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens,
       array_to_string(regexp_extract_all(text, '{TOKEN}'), '') = text AS lossless, left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS snippet,
       replace(left(text, 55), chr(10), ' ') || '...' AS short
FROM documents"""

QUERIES["word_sets"] = lambda spark, d: docs(spark, d).select("doc_id", F.size(T.word_set("text")).alias("n_distinct"), F.md5(F.array_join(F.array_sort(T.word_set("text")), " ").cast("binary")).alias("words"))
ORACLE_SQL["word_sets"] = f"SELECT doc_id, len(list_distinct(w)) AS n_distinct, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RUN}') AS w FROM documents)"


def ngrams_top(spark, d):
    """The 20 most frequent trigrams by documents."""
    g = docs(spark, d).select(F.explode(T.ngrams(T.words("text"), 3)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "gram").limit(20)


QUERIES["ngrams_top"] = ngrams_top
ORACLE_SQL["ngrams_top"] = f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t)), lambda t: NOT regexp_full_match(t, '{SPACE}+')) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w WHERE len(w) >= 3)
SELECT gram, count(*) AS n_docs FROM g GROUP BY gram ORDER BY n_docs DESC, gram LIMIT 20"""

QUERIES["sentence_counts"] = lambda spark, d: docs(spark, d).select("doc_id", F.size(T.sentences("text")).alias("n_sentences"))
ORACLE_SQL["sentence_counts"] = rf"""
SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '')) AS n_sentences FROM documents"""


def label_maps(spark, d):
    """Label functions over the sources' names and a few labels."""
    raw = F.element_at(F.array(*[F.lit(x) for x in (" it_task", "CLERICAL", "Clerical_Term ", "OTHER", "IT_TERM")]), (F.col("doc_id") % 5 + 1).cast("int"))
    x = docs(spark, d).select("doc_id", raw.alias("raw"), F.substring("text", 1, 40).alias("surface"))
    return x.select("doc_id", L.to_label("raw").alias("span_label"), L.to_label("raw", L.TO_DICTIONARY_LABEL).alias("dictionary_label"), L.is_label("raw").alias("known"), L.lenient_label("raw").alias("lenient"), L.infer_label("raw", "surface", ("the", "le ")).alias("inferred"))


QUERIES["label_maps"] = label_maps
ORACLE_SQL["label_maps"] = """
WITH x AS (SELECT doc_id, ([' it_task', 'CLERICAL', 'Clerical_Term ', 'OTHER', 'IT_TERM'])[doc_id % 5 + 1] AS raw, lower(left(text, 40)) AS s FROM documents), y AS (SELECT *, upper(trim(raw)) AS u FROM x)
SELECT doc_id, CASE WHEN u IN ('IT_TASK', 'IT_TERM') THEN 'IT_TERM' WHEN u IN ('CLERICAL', 'CLERICAL_TERM') THEN 'CLERICAL_TERM' END AS span_label,
       CASE WHEN u IN ('IT_TASK', 'IT_TERM') THEN 'IT_TASK' WHEN u IN ('CLERICAL', 'CLERICAL_TERM') THEN 'CLERICAL' END AS dictionary_label,
       u IN ('IT_TERM', 'CLERICAL_TERM') AS known, CASE WHEN raw IN ('IT_TASK', 'IT_TERM') THEN 'IT_TERM' WHEN raw IN ('CLERICAL', 'CLERICAL_TERM') THEN 'CLERICAL_TERM' ELSE raw END AS lenient,
       CASE WHEN upper(raw) LIKE '%IT%' THEN 'IT_TERM' WHEN upper(raw) LIKE '%CLERICAL%' OR s LIKE '%the%' OR s LIKE '%le %' THEN 'CLERICAL_TERM' ELSE 'IT_TERM' END AS inferred
FROM y"""


def review_routing(spark, d):
    """Predictions with clamped confidence, routed by threshold."""
    m = ml_spans(spark, d)
    return m.select("doc_id", "start", "end", L.clamp_confidence(F.col("confidence") - 0.55).alias("clamped"), L.route("confidence").alias("status"))


QUERIES["review_routing"] = review_routing
ORACLE_SQL["review_routing"] = f"""
WITH {TOK_SQL}, {PAIRS_SQL}
SELECT doc_id, start, end_ AS "end", CASE WHEN confidence - 0.55::DOUBLE > 0 THEN round(least(0.9999::DOUBLE, confidence - 0.55::DOUBLE), 4) ELSE 0.85::DOUBLE END AS clamped,
       CASE WHEN confidence >= 0.8::DOUBLE THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS status FROM ml"""
