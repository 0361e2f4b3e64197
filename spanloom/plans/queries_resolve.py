"""Queries over conflict resolution and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.config import LEADING_TRIM, TRAILING_TRIM
from ..operators import metrics as M
from ..operators import resolve as R
from ..operators.dictionary import dictionary_entities, find_term_spans
from .inputs import PAIRS_SQL, TOK_SQL, docs, gold_spans, ml_spans, stored_pairs, terms
from .queries_dictionary import ENTITIES_SQL, EXTRACT_SQL

QUERIES, ORACLE_SQL = {}, {}

BOTH_SQL = f"""{ENTITIES_SQL}, {PAIRS_SQL},
d AS (SELECT doc_id, start, end_, term, label AS category FROM dict
      WHERE NOT (lower(term) IN {TRAILING_TRIM} AND term <> upper(term))),
m AS (SELECT doc_id, start, end_, term, category, least(0.9999::DOUBLE, confidence) AS confidence, CASE WHEN confidence >= 0.8::DOUBLE THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS status FROM ml)"""


def both(spark, d):
    m = ml_spans(spark, d).select("doc_id", "start", "end", "term", "category", F.least(F.lit(0.9999), "confidence").alias("confidence"), F.lit("ML").alias("source"), L.route("confidence").alias("status"))
    return m, dictionary_entities(docs(spark, d), terms(spark, d))


def overlap_join(spark, d):
    m, dic = both(spark, d)
    return R.overlap_join(dic.select("doc_id", "start", "end"), m.select("doc_id", "start", "end"), how="left").select("doc_id", "start", "end", "r_start", "r_end")


QUERIES["overlap_join"] = overlap_join
ORACLE_SQL["overlap_join"] = f'WITH {BOTH_SQL} SELECT d.doc_id, d.start, d.end_ AS "end", m.start AS r_start, m.end_ AS r_end FROM d LEFT JOIN m ON d.doc_id = m.doc_id AND greatest(d.start, m.start) < least(d.end_, m.end_)'

RESOLVED_SQL = f"""{BOTH_SQL},
j AS (SELECT d.doc_id, d.start, d.end_, d.term, d.category, m.start AS ms, m.end_ AS me, m.category AS mc FROM d LEFT JOIN m ON d.doc_id = m.doc_id AND greatest(d.start, m.start) < least(d.end_, m.end_)),
jl AS (SELECT *, max(me - ms) OVER (PARTITION BY doc_id, start, end_) AS longest FROM j),
w AS (SELECT *, longest IS NULL OR end_ - start > longest AS wins FROM jl),
acc AS (SELECT DISTINCT doc_id, start, end_, term, category FROM w WHERE wins),
bym AS (SELECT doc_id, ms, me, bool_or(wins) AS replaced, arg_max(category, start) FILTER (WHERE NOT wins) AS link FROM w WHERE ms IS NOT NULL GROUP BY doc_id, ms, me),
sv AS (SELECT m.*, link FROM m LEFT JOIN bym ON m.doc_id = bym.doc_id AND m.start = ms AND m.end_ = me WHERE NOT coalesce(replaced, false)),
al AS (SELECT doc_id, start, end_, term, coalesce(link, category) AS category, confidence, CASE WHEN link <> category THEN 'dictionary' ELSE 'ML' END AS source, status, 0 AS side FROM sv
       UNION ALL SELECT doc_id, start, end_, term, category, 1.0, 'dictionary', 'ACCEPTED', 1 FROM acc),
resolved AS (SELECT doc_id, start, end_, term, category, confidence, source, status FROM al QUALIFY row_number() OVER (PARTITION BY doc_id, start, end_ ORDER BY side) = 1),
ev AS (SELECT doc_id, term, category AS ml_label, link AS dict_label, link AS winning_label, start, end_ FROM sv WHERE link <> category
       UNION ALL SELECT doc_id, term, mc, category, category, start, end_ FROM w WHERE wins AND mc <> category)"""

QUERIES["resolve_conflicts"] = lambda spark, d: R.resolve_conflicts(*both(spark, d))[0]
ORACLE_SQL["resolve_conflicts"] = f'WITH {RESOLVED_SQL} SELECT doc_id, start, end_ AS "end", term, category, confidence::DOUBLE AS confidence, source, status FROM resolved'
QUERIES["override_log"] = lambda spark, d: R.resolve_conflicts(*both(spark, d))[1]
ORACLE_SQL["override_log"] = f'WITH {RESOLVED_SQL} SELECT doc_id, term, ml_label, dict_label, winning_label, start, end_ AS "end" FROM ev'


def merge_adjacent(spark, d):
    """Dictionary spans, which don't overlap, merged with their neighbours of the same label."""
    found = find_term_spans(docs(spark, d), terms(spark, d)).withColumnRenamed("label", "category")
    e = found.withColumns({"confidence": F.lit(1.0), "source": F.lit("dictionary"), "status": F.lit(L.ACCEPTED)})
    return R.merge_adjacent(e, docs(spark, d)).select("doc_id", "start", "end", "category")


QUERIES["merge_adjacent"] = merge_adjacent
ORACLE_SQL["merge_adjacent"] = rf"""WITH {EXTRACT_SQL},
g AS (SELECT f.*, x.text, lag(end_) OVER o AS pe, lag(label) OVER o AS pl, lag(term) OVER o AS pt FROM found f JOIN documents x USING (doc_id) WINDOW o AS (PARTITION BY f.doc_id ORDER BY start)),
n AS (SELECT *, CASE WHEN pl = label AND trim(text[pe + 1:start], E' \n\t\r') = '' AND lower(term) NOT IN ('with') AND lower(pt) NOT IN ('with') THEN 0 ELSE 1 END AS fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM n)
SELECT doc_id, min(start) AS start, max(end_) AS "end", label AS category FROM i GROUP BY doc_id, island, label"""

QUERIES["extract_hybrid"] = lambda spark, d: R.extract(docs(spark, d), ml_spans(spark, d), terms(spark, d))[0]
QUERIES["trim_spans"] = lambda spark, d: R.trim_spans(ml_spans(spark, d).select("doc_id", "start", "end", "term", "category"))
ORACLE_SQL["trim_spans"] = f"""WITH {TOK_SQL}, {PAIRS_SQL},
lw AS (SELECT {list(LEADING_TRIM)} AS l, {list(TRAILING_TRIM)} AS t),
x AS (SELECT ml.*, split_part(term, ' ', 1) AS a, split_part(term, ' ', 2) AS b FROM ml),
y AS (SELECT x.*, list_contains(l, lower(a)) AS la, list_contains(t, lower(b)) AS tb, list_contains(l, lower(b)) OR list_contains(t, lower(b)) AS eb, list_contains(l, lower(a)) OR list_contains(t, lower(a)) AS ea FROM x, lw),
z AS (SELECT doc_id, category, CASE WHEN la THEN start + length(a) + 1 ELSE start END AS start, CASE WHEN la THEN end_ WHEN tb THEN start + length(a) ELSE end_ END AS end_,
             CASE WHEN la THEN b WHEN tb THEN a ELSE term END AS term, (la AND eb AND b <> upper(b)) OR (NOT la AND tb AND ea AND a <> upper(a)) AS gone FROM y)
SELECT doc_id, start, end_ AS "end", term, category FROM z WHERE NOT gone"""


def entity_pairs(spark, d):
    """(gold spans, model spans); the texts are cut once for both, whatever is read of them."""
    pairs = stored_pairs(spark, d)
    g = gold_spans(spark, d, pairs)
    p = ml_spans(spark, d, pairs).select("doc_id", "idx", "start", "end", "term", F.col("category").alias("label"), "confidence")
    return g, p


def status_classification(spark, d):
    g, p = entity_pairs(spark, d)
    return M.classify_status(g, p).select("doc_id", "type", "status", "gold_start", "gold_end", "gold_label", "pred_start", "pred_end", "pred_label")


QUERIES["status_classification"] = status_classification
STATUS_SQL = f"""{TOK_SQL}, {PAIRS_SQL},
j AS (SELECT g.doc_id, g.idx, g.start, g.end_, g.label, p.idx AS pi, p.start AS ps, p.end_ AS pe, p.category AS pl FROM gold g LEFT JOIN ml p ON g.doc_id = p.doc_id AND greatest(g.start, p.start) < least(g.end_, p.end_)),
jx AS (SELECT *, min(CASE WHEN start = ps AND end_ = pe THEN pi END) OVER (PARTITION BY doc_id, idx) AS x FROM j),
js AS (SELECT *, pi <= coalesce(x, pi) AS seen FROM jx),
b AS (SELECT doc_id, idx, start, end_, label, max(x) AS x, max(pi) AS pi, arg_max(pl, pi) AS pl, arg_max(ps, pi) AS ps, arg_max(pe, pi) AS pe FROM js WHERE pi IS NULL OR seen GROUP BY doc_id, idx, start, end_, label),
st AS (SELECT doc_id, 'gold' AS type, CASE WHEN x IS NOT NULL THEN CASE WHEN pl = label THEN 'correct' ELSE 'label_error' END WHEN pi IS NOT NULL THEN 'boundary_error' ELSE 'false_negative' END AS status,
              start AS gold_start, end_ AS gold_end, label AS gold_label, ps AS pred_start, pe AS pred_end, pl AS pred_label FROM b
       UNION ALL SELECT doc_id, 'prediction', 'false_positive', NULL, NULL, NULL, start, end_, category FROM ml p WHERE NOT EXISTS (SELECT 1 FROM js WHERE js.doc_id = p.doc_id AND js.pi = p.idx AND seen))"""
ORACLE_SQL["status_classification"] = f"WITH {STATUS_SQL} SELECT * FROM st"


def strict_prf(spark, d, pairs=None):
    g, p = pairs or entity_pairs(spark, d)
    return M.with_overall(M.strict_counts(g, p)).select("label", "tp", "fp", "fn", *M.prf())


QUERIES["strict_prf"] = strict_prf
ORACLE_SQL["strict_prf"] = f"""WITH {TOK_SQL}, {PAIRS_SQL},
s AS (SELECT label, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn
      FROM (SELECT label, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM (SELECT doc_id, start, end_, label, 'g' AS side FROM gold UNION ALL SELECT doc_id, start, end_, category, 'p' FROM ml) GROUP BY doc_id, start, end_, label) GROUP BY label),
a AS (SELECT * FROM s UNION ALL SELECT 'ALL', sum(tp), sum(fp), sum(fn) FROM s)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
       2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) AS f1 FROM a"""


def lenient_prf(spark, d):
    g, p = entity_pairs(spark, d)
    return M.lenient_counts(g, p).select("tp", "fp", "fn", "total_gold")


QUERIES["lenient_prf"] = lenient_prf
LENIENT_SQL = f"""{TOK_SQL}, {PAIRS_SQL},
g AS (SELECT DISTINCT doc_id, lower(term) AS t, label FROM gold), p AS (SELECT DISTINCT doc_id, lower(term) AS t, category AS label, confidence FROM ml),
h AS (SELECT g.doc_id, g.t AS gt, g.label, p.t AS pt, p.confidence FROM g JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND (contains(g.t, p.t) OR contains(p.t, g.t)))"""
ORACLE_SQL["lenient_prf"] = f"""WITH {LENIENT_SQL}, hit AS (SELECT DISTINCT doc_id, gt, label FROM h), use AS (SELECT DISTINCT doc_id, pt, label, confidence FROM h)
SELECT (SELECT count(*) FROM hit) AS tp, (SELECT count(*) FROM p) - (SELECT count(*) FROM use) AS fp, (SELECT count(*) FROM g) - (SELECT count(*) FROM hit) AS fn, (SELECT count(*) FROM gold) AS total_gold"""


def lenient_best(spark, d):
    g, p = entity_pairs(spark, d)
    return M.lenient_matches(g, p)


QUERIES["lenient_matches"] = lenient_best
ORACLE_SQL["lenient_matches"] = f"""WITH {LENIENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gt, label ORDER BY gt <> pt, -length(pt), pt, confidence) AS k FROM h)
SELECT g.doc_id, g.t AS term, g.label, r.pt AS matched, r.confidence FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.t = r.gt AND g.label = r.label AND k = 1"""


def holdout(spark, d, pairs=None, listed=None):
    """Gold spans found or missed, by whether their term is in the dictionary."""
    g, p = pairs or entity_pairs(spark, d)
    m = M.holdout_matches(g, p).join((listed or terms(spark, d)).select(F.col("term").alias("known")), F.lower("term") == F.col("known"), "left")
    c = m.groupBy(F.when(F.col("known").isNull(), "unseen").otherwise("seen").alias("term_status")).agg(F.count("matched_idx").alias("tp"), F.count_if(F.col("matched_idx").isNull()).alias("fn"))
    return M.with_overall(c, "term_status", "overall").select("term_status", "tp", "fn", (100 * L.ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"))


QUERIES["holdout_by_status"] = holdout
from .inputs import TERMS_SQL  # noqa: E402

ORACLE_SQL["holdout_by_status"] = f"""WITH {TOK_SQL}, {PAIRS_SQL}, {TERMS_SQL},
m AS (SELECT g.doc_id, g.idx, lower(g.term) AS t, bool_or(p.doc_id IS NOT NULL AND (greatest(g.start, p.start) < least(g.end_, p.end_) OR contains(lower(g.term), lower(p.term)) OR contains(lower(p.term), lower(g.term)))) AS hit
      FROM gold g LEFT JOIN ml p ON g.doc_id = p.doc_id AND g.label = p.category GROUP BY g.doc_id, g.idx, g.term),
s AS (SELECT CASE WHEN t IN (SELECT term FROM terms) THEN 'seen' ELSE 'unseen' END AS term_status, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fn FROM m GROUP BY term_status),
a AS (SELECT * FROM s UNION ALL SELECT 'overall', sum(tp), sum(fn) FROM s)
SELECT term_status, tp::BIGINT AS tp, fn::BIGINT AS fn, 100 * (tp::DOUBLE / (tp + fn)) AS recall FROM a"""


def calibration(spark, d):
    g, p = entity_pairs(spark, d)
    hit = p.join(g.select("doc_id", "start", "end", "label", F.lit(True).alias("matched")), ["doc_id", "start", "end", "label"], "left").na.fill(False, ["matched"])
    return M.calibration(hit)


QUERIES["calibration"] = calibration
ORACLE_SQL["calibration"] = f"""WITH {TOK_SQL}, {PAIRS_SQL},
c AS (SELECT round(avg(confidence) FILTER (WHERE g.doc_id IS NOT NULL), 4) AS m, round(avg(confidence) FILTER (WHERE g.doc_id IS NULL), 4) AS u
      FROM ml LEFT JOIN gold g ON ml.doc_id = g.doc_id AND ml.start = g.start AND ml.end_ = g.end_ AND ml.category = g.label)
SELECT m AS matched_mean, u AS unmatched_mean, m - u AS delta FROM c"""


def fold_counts(spark, d):
    g, p = entity_pairs(spark, d)
    fold = (F.col("doc_id") % 5).alias("fold")
    g, p = g.select("*", fold), p.select("*", fold)
    side = lambda df, c: df.groupBy("fold", "doc_id", "start", "end", "label").agg(F.count(F.lit(1)).alias(c))
    both = side(g, "g").join(side(p, "p"), ["fold", "doc_id", "start", "end", "label"], "full").na.fill(0, ["g", "p"])
    c = both.groupBy("fold", "label").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    return c.select("fold", "label", *M.prf())


QUERIES["cv_summary"] = lambda spark, d: M.metric_stats(fold_counts(spark, d), ["label"], "f1")
CV_SQL = f"""{TOK_SQL}, {PAIRS_SQL},
k AS (SELECT doc_id % 5 AS fold, label, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM (SELECT doc_id, start, end_, label, 'g' AS side FROM gold UNION ALL SELECT doc_id, start, end_, category, 'p' FROM ml) GROUP BY doc_id, start, end_, label),
c AS (SELECT fold, label, count(*) FILTER (WHERE g AND p)::DOUBLE AS tp, count(*) FILTER (WHERE p)::DOUBLE AS np, count(*) FILTER (WHERE g)::DOUBLE AS ng FROM k GROUP BY fold, label),
f AS (SELECT fold, label, tp / np AS p, tp / ng AS r, 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) AS f1 FROM c)"""
ORACLE_SQL["cv_summary"] = f"WITH {CV_SQL} SELECT label, avg(f1) AS mean, stddev_pop(f1) AS std, count(*) AS n FROM f GROUP BY label"


def cv_deltas(spark, d):
    """Fold means of recall against fold 0."""
    long = fold_counts(spark, d).select(F.col("fold").cast("string").alias("condition"), F.col("label").alias("metric"), F.col("recall").alias("value"))
    return M.deltas(long, "condition", "0", "metric", "value")


QUERIES["cv_deltas"] = cv_deltas
ORACLE_SQL["cv_deltas"] = f"WITH {CV_SQL} SELECT a.fold::VARCHAR AS condition, a.label AS metric, a.r AS value, a.r - b.r AS delta FROM f a JOIN f b ON a.label = b.label AND b.fold = 0"
