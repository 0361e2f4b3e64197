"""Queries over mining, curation, edits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import SPACE, TOKEN
from ..operators import edit as E
from ..operators import leakage as K
from ..operators import mining as M
from ..operators import report as R
from ..operators import synth as Y
from ..operators.metrics import classify_status
from ..operators.scratch import Scratch
from ..sources.tables import table
from ..streaming.extract import guard
from .inputs import PAIRS_SQL, TERMS_SQL, TOK_SQL, docs, gold_spans, ml_spans, terms
from .queries_corpus import LABELLED, labelled
from .queries_dictionary import GREEDY_SQL
from .queries_resolve import STATUS_SQL, entity_pairs
from .queries_text import STRIP

QUERIES, ORACLE_SQL = {}, {}


def record_labels():
    """Labels of a document as an array, from its quality and toxicity."""
    return F.filter(F.array(F.when(F.col("quality") == 0, "IT_TERM"), F.when(F.col("toxic") == 1, "CLERICAL_TERM")), lambda x: x.isNotNull())


QUERIES["diagnostics"] = lambda spark, d: R.diagnostics(labelled(spark, d), record_labels()).select("total", "positives", "negatives", "negative_pct", "in_band", "imbalanced", F.col("label_counts")["IT_TERM"].alias("it"), F.col("label_counts")["CLERICAL_TERM"].alias("cl"))
ORACLE_SQL["diagnostics"] = f"""WITH {LABELLED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS it, count(*) FILTER (WHERE toxic = 1) AS cl FROM l),
p AS (SELECT *, total - positives AS negatives, round(100.0::DOUBLE * ((total - positives) / total::DOUBLE), 1) AS negative_pct FROM c)
SELECT total, positives, negatives, negative_pct, negative_pct BETWEEN 25 AND 35 AS in_band, round(greatest(it, cl) / least(it, cl)::DOUBLE, 2) > 2 AS imbalanced, it, cl FROM p"""
QUERIES["class_balance"] = lambda spark, d: R.composition(labelled(spark, d), record_labels())
ORACLE_SQL["class_balance"] = f"""WITH {LABELLED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))) AS negatives, count(*) FILTER (WHERE quality = 0) AS it, count(*) FILTER (WHERE toxic = 1) AS cl FROM l)
SELECT total, negatives, it AS "IT_TERM", cl AS "CLERICAL_TERM", negatives / total::DOUBLE AS negative_ratio, it / (it + cl)::DOUBLE AS "IT_TERM_share", cl / (it + cl)::DOUBLE AS "CLERICAL_TERM_share",
       NOT negatives / total::DOUBLE BETWEEN 0.25 AND 0.35 AS negatives_off, it / (it + cl)::DOUBLE < 0.45 OR cl / (it + cl)::DOUBLE < 0.45 AS labels_off FROM c"""
QUERIES["label_distribution"] = lambda spark, d: R.value_counts(docs(spark, d), "lang")
ORACLE_SQL["label_distribution"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"


def negatives(spark, d):
    protected = K.protected_texts([docs(spark, d).where("doc_id % 3 = 2"), table(spark, d, "benchmark")])
    annotated = labelled(spark, d).where("toxic = 1")
    return M.hard_negatives(docs(spark, d), ml_spans(spark, d), annotated, protected)


NEGATIVES = f"""{TOK_SQL}, {PAIRS_SQL}, {LABELLED},
pr AS (SELECT lower({STRIP}) AS k FROM documents WHERE doc_id % 3 = 2 UNION SELECT lower({STRIP}) FROM benchmark),
fr AS (SELECT * FROM l WHERE lower({STRIP}) NOT IN (SELECT k FROM pr) AND coalesce(toxic, 0) <> 1),
hn AS (SELECT ml.doc_id, fr.text, ml.term, ml.category, ml.confidence, row_number() OVER (PARTITION BY {STRIP.replace('text', 'fr.text')}, lower(ml.term) ORDER BY ml.doc_id, ml.start) AS k FROM ml JOIN fr ON fr.doc_id = ml.doc_id WHERE ml.confidence >= 0.85::DOUBLE)"""
QUERIES["hard_negatives"] = lambda spark, d: negatives(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "false_positive_term", "false_positive_category", "confidence", "gold_entity_count")
ORACLE_SQL["hard_negatives"] = f"WITH {NEGATIVES} SELECT doc_id, md5(text) AS text, term AS false_positive_term, category AS false_positive_category, confidence, 0 AS gold_entity_count FROM hn WHERE k = 1"
QUERIES["top_fp_terms"] = lambda spark, d: M.top_terms(negatives(spark, d))
ORACLE_SQL["top_fp_terms"] = f"WITH {NEGATIVES} SELECT lower(term) AS term, count(*) AS n, min(doc_id) AS first FROM hn WHERE k = 1 GROUP BY lower(term) ORDER BY n DESC, first, term LIMIT 20"


def bench_and_talks(spark, d):
    return docs(spark, d), table(spark, d, "conversations")


QUERIES["vocab_jaccard"] = lambda spark, d: M.set_overlap(*[M.vocabulary(x) for x in bench_and_talks(spark, d)])
QUERIES["ngram_jaccard"] = lambda spark, d: M.set_overlap(*[M.vocabulary(x, n=3) for x in bench_and_talks(spark, d)])
QUERIES["corpus_overlap"] = lambda spark, d: M.corpus_overlap(*bench_and_talks(spark, d))
WORDS = f"list_filter(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t)), lambda t: NOT regexp_full_match(t, '{SPACE}+'))"
GRAMS = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
VOCAB = f"""wa AS (SELECT {WORDS} AS w FROM documents), wb AS (SELECT {WORDS} AS w FROM conversations),
a1 AS (SELECT DISTINCT unnest(w) AS g FROM wa), b1 AS (SELECT DISTINCT unnest(w) AS g FROM wb),
a3 AS (SELECT DISTINCT unnest({GRAMS}) AS g FROM wa WHERE len(w) >= 3), b3 AS (SELECT DISTINCT unnest({GRAMS}) AS g FROM wb WHERE len(w) >= 3)"""


def _overlap(n: int, more: str = "") -> str:
    return f"SELECT na AS n_a, nb AS n_b, sh AS shared, sh / (na + nb - sh)::DOUBLE AS jaccard, sh / nb::DOUBLE AS covered{more} FROM (SELECT (SELECT count(*) FROM a{n}) AS na, (SELECT count(*) FROM b{n}) AS nb, (SELECT count(*) FROM a{n} JOIN b{n} USING (g)) AS sh)"


ORACLE_SQL["vocab_jaccard"] = f"WITH {VOCAB} {_overlap(1)}"
ORACLE_SQL["ngram_jaccard"] = f"WITH {VOCAB} {_overlap(3)}"
MEANS = ", (SELECT avg(len(w)) FROM wa) AS mean_a, (SELECT avg(len(w)) FROM wb) AS mean_b"
ORACLE_SQL["corpus_overlap"] = f"WITH {VOCAB} {_overlap(1, ', ' + chr(39) + 'vocabulary' + chr(39) + ' AS unit' + MEANS)} UNION ALL {_overlap(3, ', ' + chr(39) + 'trigrams' + chr(39) + ' AS unit' + MEANS)}"


def curated(spark, d):
    """Conversation turns and all documents as candidates against documents in three roles."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text")
    own = docs(spark, d)
    more = own.select((F.col("doc_id") + 10_000_000).alias("idx"), "text")
    return Y.curation_reasons(turns.unionByName(more), own.where("doc_id % 3 = 0"), own.where("doc_id % 3 = 1"), own.where("doc_id % 3 = 2"), terms(spark, d), "idx")


CURATED = rf"""{TERMS_SQL}, cr AS (SELECT conv_id * 1000 + turn AS idx, text FROM conversations UNION ALL SELECT doc_id + 10000000, text FROM documents),
ck AS (SELECT idx, text, {STRIP} AS k, min(idx) OVER (PARTITION BY {STRIP}) AS f FROM cr), dk AS (SELECT DISTINCT doc_id % 3 AS part, {STRIP} AS k FROM documents),
ct AS (SELECT idx, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM cr),
cg AS (SELECT idx, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])))) AS g FROM ct),
ch AS (SELECT DISTINCT idx FROM cg JOIN terms ON g = term),
cu AS (SELECT idx, text, CASE WHEN idx <> f OR k IN (SELECT k FROM dk WHERE part = 0) THEN 'duplicate' WHEN k IN (SELECT k FROM dk WHERE part = 1) THEN 'test_leak' WHEN k IN (SELECT k FROM dk WHERE part = 2) THEN 'dev_leak'
              WHEN idx IN (SELECT idx FROM ch) THEN 'accidental_entity' ELSE 'accept' END AS reason FROM ck)"""
QUERIES["curation_reasons"] = lambda spark, d: curated(spark, d).select("idx", "reason")
ORACLE_SQL["curation_reasons"] = f"WITH {CURATED} SELECT idx, reason FROM cu"


def build_pool(spark, d):
    """Real training documents and accepted candidates, counted by type."""
    pool = K.tag_union({"real": docs(spark, d).where("doc_id % 3 = 0").select("text"), "hard_negative": curated(spark, d).where("reason = 'accept'").select("text")})
    return pool.groupBy("augmentation_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES["build_pool"] = build_pool
ORACLE_SQL["build_pool"] = f"WITH {CURATED} SELECT 'real' AS augmentation_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'hard_negative', count(*), CAST(sum(length(text)) AS BIGINT) FROM cu WHERE reason = 'accept' HAVING count(*) > 0"

def first_seen():
    return F.struct("doc_id", "start")


def plain_gold(spark, d):
    return gold_spans(spark, d).select("doc_id", "start", "end", "label", "term")


QUERIES["consistency_audit"] = lambda spark, d: E.consistency(gold_spans(spark, d), first_seen()).select("term", "n_labels", "total", F.col("counts")["IT_TERM"].alias("it"), F.col("counts")["CLERICAL_TERM"].alias("cl"))
CONSISTENT = f"""{TOK_SQL}, {PAIRS_SQL}, gl AS (SELECT lower(term) AS term, label, count(*) AS n, min(doc_id * 10000000 + start) AS f FROM gold GROUP BY ALL)"""
ORACLE_SQL["consistency_audit"] = f"WITH {CONSISTENT} SELECT term, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS total, max(n) FILTER (WHERE label = 'IT_TERM') AS it, max(n) FILTER (WHERE label = 'CLERICAL_TERM') AS cl FROM gl GROUP BY term HAVING count(*) > 1"
QUERIES["majority_label"] = lambda spark, d: E.consistency(gold_spans(spark, d), first_seen()).select("term", "majority")
ORACLE_SQL["majority_label"] = f"WITH {CONSISTENT}, r AS (SELECT *, count(*) OVER (PARTITION BY term) AS k, row_number() OVER (PARTITION BY term ORDER BY n DESC, f) AS o FROM gl) SELECT term, label AS majority FROM r WHERE k > 1 AND o = 1"
QUERIES["resolve_to_majority"] = lambda spark, d: E.resolve_to_majority(docs(spark, d), Scratch(spark, "gold").save(plain_gold(spark, d)), first_seen())[1]
ORACLE_SQL["resolve_to_majority"] = rf"""WITH {CONSISTENT}, r AS (SELECT *, count(*) OVER (PARTITION BY term) AS k, row_number() OVER (PARTITION BY term ORDER BY n DESC, f) AS o FROM gl),
mj AS MATERIALIZED (SELECT term, label AS ml, contains(term, ' ') AS two FROM r WHERE k > 1 AND o = 1),
tg AS (SELECT doc_id, start, tok, tok || coalesce(lead(tok, 1) OVER w, '') || coalesce(lead(tok, 2) OVER w, '') AS three FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
pl AS MATERIALIZED (SELECT doc_id, start AS ps, start + length(tok) AS pe, ml FROM tg JOIN mj ON lower(tok) = term AND NOT two UNION ALL SELECT doc_id, start, start + length(three), ml FROM tg JOIN mj ON lower(three) = term AND two),
mt AS (SELECT pl.*, g.start AS gs, g.end_ AS ge, g.label, row_number() OVER (PARTITION BY pl.doc_id, ps, pe ORDER BY g.start, g.end_, g.label) AS k FROM pl LEFT JOIN gold g ON g.doc_id = pl.doc_id AND g.start < pe AND g.end_ > ps),
sy AS MATERIALIZED (SELECT doc_id, ps AS start, pe AS end_, ml AS label, CASE WHEN gs IS NULL THEN 'added' WHEN gs = ps AND ge = pe AND label <> ml THEN 'relabelled' WHEN gs = ps AND ge = pe THEN 'same' ELSE 'skipped' END AS action FROM mt WHERE k = 1),
ad AS (SELECT doc_id, start, end_, CASE WHEN start < max(end_) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sy WHERE action = 'added'),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM ad),
fl AS (SELECT doc_id, list({{'s': start, 'e': end_}} ORDER BY start - end_, start) AS h FROM il GROUP BY doc_id, island),
fk AS (SELECT doc_id, list_reduce(list_transform(h, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: greatest(y.s, x[1].s) < least(y.e, x[1].e))) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM fl),
free AS (SELECT doc_id, k.s AS start, k.e AS end_ FROM (SELECT doc_id, unnest(k) AS k FROM fk))
SELECT sy.doc_id, sy.start, sy.end_ AS "end", sy.label, CASE WHEN action = 'added' AND free.start IS NULL THEN 'skipped' ELSE action END AS action FROM sy LEFT JOIN free ON sy.doc_id = free.doc_id AND sy.start = free.start AND sy.end_ = free.end_"""


def sync_add(spark, d):
    """Every 'the' labelled: what happens at each place."""
    return E.sync_add(docs(spark, d), plain_gold(spark, d), "the", "IT_TERM")[1]


QUERIES["sync_add"] = sync_add
SYNC = f"""{TOK_SQL}, {PAIRS_SQL}, pl AS (SELECT doc_id, start AS ps, start + 3 AS pe FROM tok WHERE lower(tok) = 'the'),
mt AS (SELECT pl.*, g.start AS gs, g.end_ AS ge, g.label, row_number() OVER (PARTITION BY pl.doc_id, ps ORDER BY g.start, g.end_, g.label) AS k FROM pl LEFT JOIN gold g ON g.doc_id = pl.doc_id AND g.start < pe AND g.end_ > ps),
sy AS (SELECT doc_id, ps AS start, pe AS "end", CASE WHEN gs IS NULL THEN 'added' WHEN gs = ps AND ge = pe AND label <> 'IT_TERM' THEN 'relabelled' WHEN gs = ps AND ge = pe THEN 'same' ELSE 'skipped' END AS action FROM mt WHERE k = 1)"""
ORACLE_SQL["sync_add"] = f"WITH {SYNC} SELECT * FROM sy"
QUERIES["sync_counts"] = lambda spark, d: E.change_counts(sync_add(spark, d))
ORACLE_SQL["sync_counts"] = f"WITH {SYNC} SELECT count(*) FILTER (WHERE action = 'added') AS added, count(*) FILTER (WHERE action = 'relabelled') AS relabelled, count(DISTINCT CASE WHEN action IN ('added', 'relabelled') THEN doc_id END) AS affected FROM sy"
QUERIES["sync_delete"] = lambda spark, d: E.sync_delete(plain_gold(spark, d), "THE")
ORACLE_SQL["sync_delete"] = f"WITH {TOK_SQL}, {PAIRS_SQL} SELECT doc_id, start, end_ AS \"end\", label, term FROM gold WHERE lower(term) <> 'the'"
QUERIES["edit_impact"] = lambda spark, d: E.impact(plain_gold(spark, d), "the")
ORACLE_SQL["edit_impact"] = f"WITH {TOK_SQL}, {PAIRS_SQL} SELECT count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM gold WHERE lower(term) = 'the'"
QUERIES["invalid_spans"] = lambda spark, d: E.invalid_spans(docs(spark, d), plain_gold(spark, d).withColumn("end", F.col("end") + 40)).select("doc_id", "start", "end")
ORACLE_SQL["invalid_spans"] = f'WITH {TOK_SQL}, {PAIRS_SQL} SELECT doc_id, start, end_ + 40 AS "end" FROM gold JOIN documents USING (doc_id) WHERE end_ + 40 > length(text)'
QUERIES["policy_report"] = lambda spark, d: E.policy_report(docs(spark, d), plain_gold(spark, d), ("the", "of")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
ORACLE_SQL["policy_report"] = f"""WITH {TOK_SQL}, {PAIRS_SQL}, o AS (SELECT DISTINCT a.doc_id, a.start, a.end_ FROM gold a JOIN gold b ON a.doc_id = b.doc_id AND greatest(a.start, b.start) < least(a.end_, b.end_) AND (a.start, a.end_) < (b.start, b.end_))
SELECT 'starts_with_listed_word' AS rule, count(*) AS n FROM gold WHERE lower(split_part(term, ' ', 1)) IN ('the', 'of') HAVING count(*) > 0 UNION ALL SELECT 'overlap', count(*) FROM o HAVING count(*) > 0"""


def statuses(spark, d):
    return classify_status(*entity_pairs(spark, d))


QUERIES["status_rollup"] = lambda spark, d: R.status_rollup(statuses(spark, d), ["doc_id"])
ORACLE_SQL["status_rollup"] = f"""WITH {STATUS_SQL} SELECT doc_id, CASE WHEN bool_or(status = 'boundary_error') THEN 'boundary' WHEN bool_or(status = 'false_negative') THEN 'missed' WHEN bool_or(status = 'false_positive') THEN 'spurious' WHEN bool_or(status = 'label_error') THEN 'error' ELSE 'correct' END AS rollup FROM st GROUP BY doc_id"""
QUERIES["status_banner"] = lambda spark, d: R.banner(statuses(spark, d))
ORACLE_SQL["status_banner"] = f"""WITH {STATUS_SQL}, n AS (SELECT count(*) FILTER (WHERE type = 'gold') AS gold, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'boundary_error') AS boundary, count(*) FILTER (WHERE status = 'false_positive') AS spurious, count(*) FILTER (WHERE status = 'false_negative') AS missed FROM st)
SELECT *, correct / gold::DOUBLE AS accuracy FROM n"""


def boundaries(spark, d):
    s = statuses(spark, d)
    return s.select("doc_id", "gold_start", "pred_start", R.boundary_text("gold_start", "gold_end", "pred_start", "pred_end").alias("explained"))


QUERIES["boundary_text"] = boundaries
ORACLE_SQL["boundary_text"] = f"""WITH {STATUS_SQL} SELECT doc_id, gold_start, pred_start, CASE WHEN gold_start IS NULL THEN 'spurious' WHEN pred_start IS NULL THEN 'missed' WHEN gold_start = pred_start AND gold_end = pred_end THEN 'exact'
ELSE concat_ws(' | ', CASE WHEN pred_start > gold_start THEN 'prefix missed ' || (pred_start - gold_start) WHEN pred_start < gold_start THEN 'prefix added ' || (gold_start - pred_start) END,
                      CASE WHEN gold_end > pred_end THEN 'suffix missed ' || (gold_end - pred_end) WHEN gold_end < pred_end THEN 'suffix added ' || (pred_end - gold_end) END) END AS explained FROM st"""


QUERIES["request_guard"] = lambda spark, d: guard(docs(spark, d), 5000).select("doc_id", "reject_reason")
ORACLE_SQL["request_guard"] = f"SELECT doc_id, CASE WHEN {STRIP} = '' THEN 'blank' WHEN length(text) > 5000 THEN 'too_long' END AS reject_reason FROM documents"


def paraphrase_candidates(documents, spans):
    """Whole documents with an opening as paraphrases of themselves, with all spans in text order."""
    e = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).alias("entities"))
    c = documents.select("doc_id", "text").join(e, "doc_id", "left")
    return c.select(T.source_id("text").alias("source_id"), F.col("doc_id").alias("rank"), F.col("text").alias("source_text"), F.concat(F.lit("So: "), "text").alias("text"), F.coalesce("entities", F.array().cast(Y.SPANS)).alias("entities"))


def accepted_paraphrases(spark, d):
    """Documents with an opening as candidates: entities relocated, texts filtered, one for each source; a row for each entity, or one with nulls."""
    c = paraphrase_candidates(docs(spark, d), gold_spans(spark, d))
    out = Y.accept_candidates(c, K.protected_texts([table(spark, d, "benchmark")]), Y.quality_reason(blocked=("the",)))
    return out.select("source_id", "rank", F.explode_outer("entities").alias("e")).select("source_id", "rank", "e.start", "e.end")


QUERIES["accepted_paraphrases"] = accepted_paraphrases
