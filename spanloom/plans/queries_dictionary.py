"""Queries over dictionary matching and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.config import TRAILING_TRIM
from ..operators import dictionary as D
from ..operators import summary as S
from ..operators.scratch import Scratch
from ..operators.tokens import rule_token_table, whole_texts
from ..sources.readers import known_terms, terms_by_label
from ..streaming.terms import happenings, term_counts
from .inputs import TERMS_SQL, TOK_SQL, docs, ml_spans, terms

QUERIES, ORACLE_SQL = {}, {}

QUERIES["terms_dictionary"] = terms
ORACLE_SQL["terms_dictionary"] = f"WITH {TERMS_SQL} SELECT term, label, ord FROM terms"
QUERIES["terms_by_label"] = lambda spark, d: terms_by_label(terms(spark, d))
ORACLE_SQL["terms_by_label"] = f"WITH {TERMS_SQL} SELECT label, list(term ORDER BY term) AS terms FROM terms GROUP BY label"
QUERIES["known_terms"] = lambda spark, d: known_terms(terms(spark, d))
ORACLE_SQL["known_terms"] = f"WITH {TERMS_SQL} SELECT DISTINCT lower(trim(term)) AS term FROM terms"

QUERIES["token_table"] = lambda spark, d: D.token_table(docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.max(F.col("start") + F.length("tok")).alias("length"))
ORACLE_SQL["token_table"] = f"WITH {TOK_SQL} SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, max(start + length(tok)) AS length FROM tok GROUP BY doc_id"

HITS_SQL = rf"""
{TOK_SQL}, {TERMS_SQL},
tn AS (SELECT term, label, ord, len(regexp_extract_all(term, '[\p{{L}}\p{{N}}_]+|[ \t\n\r\f]+|[^\p{{L}}\p{{N}}_ \t\n\r\f]')) AS n FROM terms),
tg AS (SELECT doc_id, start, tok, tok || coalesce(lead(tok, 1) OVER w, '') || coalesce(lead(tok, 2) OVER w, '') AS three FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
hits AS (SELECT doc_id, start, CASE WHEN n = 1 THEN tok ELSE three END AS surface, label, ord, n FROM tg JOIN tn ON (n = 1 AND lower(tok) = term) OR (n = 3 AND lower(three) = term))"""

QUERIES["dict_candidates"] = lambda spark, d: D.match_terms(docs(spark, d), terms(spark, d)).select("doc_id", "start", "end", "term", "label")
ORACLE_SQL["dict_candidates"] = f'WITH {HITS_SQL} SELECT doc_id, start, start + length(surface) AS "end", surface AS term, label FROM hits'

QUERIES["dict_candidates_join"] = lambda spark, d: D.match_by_join(docs(spark, d), terms(spark, d)).select("doc_id", "start", "end", "term", "label")
ORACLE_SQL["dict_candidates_join"] = ORACLE_SQL["dict_candidates"]

#: Frequent words and word pairs with letters beyond ASCII, each as some document spells it or in other capitals.
ACCENTED_SQL = """
tw AS (SELECT list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[ ]|[^\\p{L}\\p{N}_ ]'), lambda x: true) AS w FROM documents),
t0 AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w) - 1), lambda i: CASE WHEN w[i + 1] = ' ' THEN w[i] || ' ' || w[i + 2] ELSE '' END))) AS s FROM tw),
t1 AS (SELECT replace(lower(s), 'ς', 'σ') AS f, max(s) AS s, count(*) AS n FROM t0 WHERE regexp_full_match(s, '[\\p{L}]+( [\\p{L}]+)?') AND regexp_matches(s, '[^\\x00-\\x7F]') GROUP BY f),
t2 AS (SELECT s, row_number() OVER (ORDER BY n DESC, s) AS r FROM t1),
terms AS (SELECT CASE r % 3 WHEN 0 THEN s WHEN 1 THEN lower(s) ELSE translate(s, 'abcdefghijklmnopqrstuvwxyzäöüéèêàç', 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇ') END AS term,
                 CASE WHEN r % 2 = 1 THEN 'IT_TERM' ELSE 'CLERICAL_TERM' END AS label, r AS ord FROM t2 WHERE r <= 120)"""


def accented_terms(spark, d):
    """(term, label, ord) like ACCENTED_SQL: 120 terms."""
    w = docs(spark, d).select(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[ ]|[^\p{L}\p{N}_ ]"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.when(F.get("w", i) == " ", F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i + 1))))
    s = w.select(F.explode(F.concat("w", pairs)).alias("s")).where(r"s rlike '^\\p{L}+( \\p{L}+)?$' and s rlike '[^\\x00-\\x7F]'")
    s = s.groupBy("s").agg(F.count(F.lit(1)).alias("n")).groupBy(F.replace(F.lower("s"), F.lit("ς"), F.lit("σ")).alias("f")).agg(F.max("s").alias("s"), F.sum("n").alias("n"))
    best = s.orderBy(F.desc("n"), "s").limit(120).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "s")))
    low, up = "abcdefghijklmnopqrstuvwxyzäöüéèêàç", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇ"
    term = F.when(F.col("r") % 3 == 0, F.col("s")).when(F.col("r") % 3 == 1, F.lower("s")).otherwise(F.translate("s", low, up))
    return Scratch(spark, "terms").save(best.select(term.alias("term"), F.when(F.col("r") % 2 == 1, "IT_TERM").otherwise("CLERICAL_TERM").alias("label"), F.col("r").alias("ord")))


ACCENTED_HITS_SQL = rf"""WITH {TOK_SQL}, {ACCENTED_SQL},
tn AS (SELECT replace(lower(term), 'ς', 'σ') AS f, label, ord, len(regexp_extract_all(term, '[\p{{L}}\p{{N}}_]+|[ \t\n\r\f]+|[^\p{{L}}\p{{N}}_ \t\n\r\f]')) AS n FROM terms),
tg AS (SELECT doc_id, start, tok, tok || coalesce(lead(tok, 1) OVER w, '') || coalesce(lead(tok, 2) OVER w, '') AS three FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, start, start + length(CASE WHEN n = 1 THEN tok ELSE three END) AS "end", CASE WHEN n = 1 THEN tok ELSE three END AS term, label
FROM tg JOIN tn ON (n = 1 AND replace(lower(tok), 'ς', 'σ') = f) OR (n = 3 AND replace(lower(three), 'ς', 'σ') = f)"""
QUERIES["dict_accented"] = lambda spark, d: D.match_terms(docs(spark, d), accented_terms(spark, d)).select("doc_id", "start", "end", "term", "label")
ORACLE_SQL["dict_accented"] = ACCENTED_HITS_SQL
QUERIES["dict_accented_join"] = lambda spark, d: D.match_by_join(docs(spark, d), accented_terms(spark, d)).select("doc_id", "start", "end", "term", "label")
ORACLE_SQL["dict_accented_join"] = ACCENTED_HITS_SQL

#: A greedy choice in SQL: hits in order are folded into the list of those taken.
GREEDY_SQL = """
{name}_l AS (SELECT doc_id, list({{'s': start, 'e': start + length(surface), 't': surface, 'l': label}} ORDER BY {order}) AS h FROM hits GROUP BY doc_id),
{name}_k AS (SELECT doc_id, list_reduce(list_transform(h, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: greatest(y.s, x[1].s) < least(y.e, x[1].e))) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM {name}_l),
{name} AS (SELECT doc_id, k.s AS start, k.e AS end_, k.t AS term, k.l AS label FROM (SELECT doc_id, unnest(k) AS k FROM {name}_k))"""
EXTRACT_SQL = HITS_SQL + "," + GREEDY_SQL.format(name="found", order="ord, start")
ENTITIES_SQL = HITS_SQL + "," + GREEDY_SQL.format(name="dict", order="-n, start, ord")

QUERIES["dict_extract"] = lambda spark, d: D.find_term_spans(docs(spark, d), terms(spark, d))
ORACLE_SQL["dict_extract"] = f'WITH {EXTRACT_SQL} SELECT doc_id, start, end_ AS "end", term, label FROM found'
QUERIES["dict_entities"] = lambda spark, d: D.dictionary_entities(docs(spark, d), terms(spark, d))
ORACLE_SQL["dict_entities"] = f"""WITH {ENTITIES_SQL}
SELECT doc_id, start, end_ AS "end", term, label AS category, 1.0::DOUBLE AS confidence, 'dictionary' AS source, 'ACCEPTED' AS status FROM dict
WHERE NOT (lower(term) IN {TRAILING_TRIM} AND term <> upper(term))"""


def dict_summary(spark, d):
    """The flagship: documents with dictionary matches and their summary."""
    found = D.find_term_spans(docs(spark, d), terms(spark, d)).withColumnRenamed("label", "category")
    return S.summarise(S.deduplicate_entities(found))


QUERIES["dict_summary"] = dict_summary
ORACLE_SQL["dict_summary"] = f"""WITH {EXTRACT_SQL},
u AS (SELECT doc_id, lower(regexp_replace(trim(term), '\\s+', ' ', 'g')) AS t, label, count(*) AS f FROM found GROUP BY doc_id, t, label),
s AS (SELECT doc_id, CAST(sum(f) AS BIGINT) AS total_occurrences, count(*) AS unique_entities, count(*) FILTER (WHERE label = 'IT_TERM') AS IT_TERM, count(*) FILTER (WHERE label = 'CLERICAL_TERM') AS CLERICAL_TERM FROM u GROUP BY doc_id)
SELECT *, round(100.0::DOUBLE * (IT_TERM::DOUBLE / unique_entities), 1) AS IT_TERM_percentage, round(100.0::DOUBLE * (CLERICAL_TERM::DOUBLE / unique_entities), 1) AS CLERICAL_TERM_percentage FROM s"""

QUERIES["entity_dedup"] = lambda spark, d: S.deduplicate_entities(D.find_term_spans(docs(spark, d), terms(spark, d)).withColumnRenamed("label", "category"))
ORACLE_SQL["entity_dedup"] = f"""WITH {EXTRACT_SQL}
SELECT doc_id, label AS category, min(start) AS start, arg_min(end_, start) AS "end", arg_min(term, start) AS term, count(*) AS frequency FROM found GROUP BY doc_id, lower(regexp_replace(trim(term), '\\s+', ' ', 'g')), label"""

QUERIES["filtered_entities"] = lambda spark, d: S.filter_entities(D.dictionary_entities(docs(spark, d), terms(spark, d)), term="TH", category="IT_TERM", status="ACCEPTED", source="dictionary").select("doc_id", "start", "term")
ORACLE_SQL["filtered_entities"] = f"WITH {ENTITIES_SQL} SELECT doc_id, start, term FROM dict WHERE lower(term) LIKE '%th%' AND label = 'IT_TERM'"


def span_alignment(spark, d):
    """Model spans shifted by one character, moved back to token ends in both ways."""
    shifted = ml_spans(spark, d).select("doc_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), "category")
    toks = D.token_table(docs(spark, d))
    inside = D.align_spans(toks, shifted).withColumn("mode", F.lit("contract"))
    return inside.unionByName(D.align_spans(toks, shifted, mode="expand").withColumn("mode", F.lit("expand")))


QUERIES["span_alignment"] = span_alignment
from .inputs import PAIRS_SQL  # noqa: E402

ORACLE_SQL["span_alignment"] = rf"""WITH {TOK_SQL}, {PAIRS_SQL},
sp AS (SELECT doc_id, start + 1 AS rs, end_ + 1 AS re, category FROM ml),
wt AS (SELECT doc_id, start AS s, start + length(tok) AS e FROM tok WHERE NOT regexp_full_match(tok, '[ \t\n\r\f]+')),
j AS (SELECT sp.doc_id, rs, re, category, min(s) FILTER (WHERE s >= rs AND e <= re) AS s1, max(e) FILTER (WHERE s >= rs AND e <= re) AS e1, min(s) AS s2, max(e) AS e2
      FROM sp JOIN wt ON sp.doc_id = wt.doc_id AND s < re AND e > rs GROUP BY ALL)
SELECT doc_id, category, rs AS raw_start, re AS raw_end, s1 AS start, e1 AS "end", 'contract' AS mode FROM j WHERE s1 IS NOT NULL
UNION ALL SELECT doc_id, category, rs, re, coalesce(s1, s2), coalesce(e1, e2), 'expand' FROM j"""


def rule_tokens_whole(spark, d):
    """Each text put together again from its rule tokens, with the end of the last one."""
    return whole_texts(rule_token_table(docs(spark, d)))


QUERIES["rule_tokens_whole"] = rule_tokens_whole
ORACLE_SQL["rule_tokens_whole"] = "SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n_chars FROM documents WHERE length(text) > 0"


def term_happenings(spark, d):
    """Counts of dictionary terms by label: how often found, in how many documents."""
    found = D.find_term_spans(docs(spark, d), terms(spark, d)).withColumnRenamed("label", "category")
    return term_counts(happenings(found))


QUERIES["term_counts"] = term_happenings
ORACLE_SQL["term_counts"] = f"WITH {EXTRACT_SQL} SELECT lower(term) AS term, label, count(*) AS found, 0::BIGINT AS overruled, count(DISTINCT doc_id) AS documents FROM found GROUP BY ALL"
