"""Queries over providers of confidence, quality filters, model comparison and fold pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.config import LEADING_TRIM, TRAILING_TRIM
from ..functions import text as T
from ..operators import dictionary as D
from ..operators import leakage as K
from ..operators import metrics as M
from ..operators import provider as V
from ..operators import report as R
from ..operators import resolve as X
from ..operators import split as P
from ..operators import synth as Y
from ..operators import tagger as G
from ..operators.scratch import Scratch
from ..operators.summary import batch_rows, review_flag
from ..sources.tables import table
from .inputs import PAIRS_SQL, TERMS_SQL, TOK_SQL, docs, gold_spans, ml_spans, terms
from .queries_resolve import RESOLVED_SQL, entity_pairs

QUERIES, ORACLE_SQL = {}, {}

TRIMMED = f"""{TOK_SQL}, {PAIRS_SQL}, {TERMS_SQL},
lw AS (SELECT {list(LEADING_TRIM)} AS l, {list(TRAILING_TRIM)} AS t),
x AS (SELECT ml.*, split_part(term, ' ', 1) AS a, split_part(term, ' ', 2) AS b, lower(term) IN (SELECT term FROM terms) AS safe FROM ml),
y AS (SELECT x.*, NOT safe AND list_contains(l, lower(a)) AS la, NOT safe AND list_contains(t, lower(b)) AS tb, list_contains(l, lower(b)) OR list_contains(t, lower(b)) AS eb, list_contains(l, lower(a)) OR list_contains(t, lower(a)) AS ea FROM x, lw),
z AS (SELECT doc_id, category, round(least(0.9999::DOUBLE, confidence), 4) AS confidence, CASE WHEN la THEN start + length(a) + 1 ELSE start END AS start, CASE WHEN la THEN end_ WHEN tb THEN start + length(a) ELSE end_ END AS end_,
             CASE WHEN la THEN b WHEN tb THEN a ELSE term END AS term, (la AND eb AND b <> upper(b)) OR (NOT la AND tb AND ea AND a <> upper(a)) AS gone FROM y),
me AS (SELECT doc_id, start, end_, term, category, confidence, CASE WHEN confidence >= 0.8::DOUBLE THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS status FROM z WHERE NOT gone)"""

QUERIES["model_entities"] = lambda spark, d: X.model_entities(ml_spans(spark, d), terms(spark, d).select("term"))
ORACLE_SQL["model_entities"] = f"WITH {TRIMMED} SELECT doc_id, start, end_ AS \"end\", term, category, confidence, 'ML' AS source, status FROM me"


def review_documents(spark, d):
    e = X.model_entities(ml_spans(spark, d), terms(spark, d).select("term"))
    return batch_rows(e).join(review_flag(e), "doc_id")


QUERIES["review_documents"] = review_documents
ORACLE_SQL["review_documents"] = f"""WITH {TRIMMED} SELECT doc_id, count(*) AS occurrences, count(*) FILTER (WHERE category = 'IT_TERM') AS "IT_TERM", count(*) FILTER (WHERE category = 'CLERICAL_TERM') AS "CLERICAL_TERM",
count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS review, bool_or(status = 'NEEDS_REVIEW') AS has_review_items FROM me GROUP BY doc_id"""


def beam_confidence(spark, d):
    """Confidence of model spans from three stand-in beams: gold spans with probabilities by token number."""
    beams = gold_spans(spark, d).select("doc_id", "start", "end", F.col("label").alias("category"), F.explode(F.array(*[F.struct(F.lit(k).alias("beam"), ((F.col("idx") % (k + 2) + 1) / F.lit(8.0 * (k + 1))).alias("p")) for k in range(3)])).alias("b")).select("doc_id", "start", "end", "category", "b.*")
    return X.beam_confidence(beams, ml_spans(spark, d).select("doc_id", "start", "end", "category"))


QUERIES["beam_confidence"] = beam_confidence
ORACLE_SQL["beam_confidence"] = f"""WITH {TOK_SQL}, {PAIRS_SQL},
b AS (SELECT doc_id, start, end_, label, k AS beam, (idx % (k + 2) + 1) / (8.0::DOUBLE * (k + 1)) AS p FROM gold, (SELECT unnest([0, 1, 2]) AS k)),
q AS (SELECT ml.doc_id, ml.start, ml.end_, ml.category, b.beam, max(b.p) AS p FROM ml JOIN b ON ml.doc_id = b.doc_id AND greatest(ml.start, b.start) < least(ml.end_, b.end_) AND b.label = ml.category GROUP BY ALL),
s AS (SELECT doc_id, start, end_, category, sum(p) AS p FROM q GROUP BY ALL)
SELECT doc_id, start, end_ AS "end", category, CASE WHEN p > 0 THEN round(least(0.9999::DOUBLE, p), 4) ELSE 0.85::DOUBLE END AS confidence FROM ml LEFT JOIN s USING (doc_id, start, end_, category)"""


def quality_reasons(spark, d):
    """Why a document would be rejected as generated text, by its gold spans."""
    e = gold_spans(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")).alias("entities"))
    x = docs(spark, d).select("doc_id", "text").join(e, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(Y.SPANS)))
    return x.select("doc_id", Y.quality_reason(blocked=("the",), bare=("of", "a"), longest=1500, endings=(" the", " le"), exempt=("of the",)).alias("reason"))


QUERIES["quality_reasons"] = quality_reasons
ORACLE_SQL["quality_reasons"] = f"""WITH {TOK_SQL}, {PAIRS_SQL}, g AS (SELECT doc_id, list(lower(term)) AS s FROM gold GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(trim(text)) < 10 OR length(text) > 1500 THEN 'length' WHEN len(list_filter(s, lambda t: t IN ('the', 'of', 'a'))) > 0 THEN 'blocked_term'
       WHEN len(list_filter(s, lambda t: t <> 'of the' AND (suffix(t, ' the') OR suffix(t, ' le')))) > 0 THEN 'loose_ending' END AS reason FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def _status_sql(n: int, least: float) -> str:
    """Errors per document of the stand-in model that keeps predictions from a confidence on."""
    return f"""
p{n} AS (SELECT * FROM ml WHERE confidence >= {least}::DOUBLE),
j{n} AS (SELECT g.doc_id, g.idx, g.label, p.idx AS pi, p.category AS pl, g.start = p.start AND g.end_ = p.end_ AS exact FROM gold g LEFT JOIN p{n} p ON g.doc_id = p.doc_id AND greatest(g.start, p.start) < least(g.end_, p.end_)),
k{n} AS (SELECT *, pi <= coalesce(min(CASE WHEN exact THEN pi END) OVER (PARTITION BY doc_id, idx), pi) AS seen FROM j{n}),
g{n} AS (SELECT doc_id, idx, bool_or(coalesce(exact AND pl = label, false)) AS ok FROM k{n} WHERE pi IS NULL OR seen GROUP BY doc_id, idx),
e{n} AS (SELECT doc_id, CAST(sum(bad) AS BIGINT) AS errors FROM (SELECT doc_id, CASE WHEN ok THEN 0 ELSE 1 END AS bad FROM g{n}
         UNION ALL SELECT doc_id, 1 FROM p{n} p WHERE NOT EXISTS (SELECT 1 FROM k{n} k WHERE k.doc_id = p.doc_id AND k.pi = p.idx AND seen)) GROUP BY doc_id)"""


def align_models(spark, d):
    """Errors of three stand-in models: predictions of all, of confident, and of very confident spans."""
    g, p = entity_pairs(spark, d)

    def errors(least: float):
        s = M.classify_status(g, p.where(F.col("confidence") >= least))
        return s.groupBy("doc_id").agg(F.count_if(F.col("status") != "correct").alias("errors"))

    return R.align_models(errors(0.0), errors(0.7), errors(0.9))


QUERIES["align_models"] = align_models
ORACLE_SQL["align_models"] = f"""WITH {TOK_SQL}, {PAIRS_SQL}, {_status_sql(0, 0.0)}, {_status_sql(1, 0.7)}, {_status_sql(2, 0.9)},
a AS (SELECT e0.doc_id, e0.errors AS base, coalesce(e1.errors, 0) AS second, coalesce(e2.errors, 0) AS third FROM e0 LEFT JOIN e1 ON e0.doc_id = e1.doc_id LEFT JOIN e2 ON e0.doc_id = e2.doc_id)
SELECT *, CASE WHEN third = 0 AND base > 0 THEN 'fixed' WHEN base = 0 AND second = 0 AND third = 0 THEN 'all_correct' WHEN base > 0 AND second > 0 AND third > 0 THEN 'all_wrong' ELSE 'divergent' END AS consensus FROM a"""


def mode_comparison(spark, d, pairs=None, listed=None):
    """Strict counts of the model alone, of its confident spans, of the dictionary, and of both as the hybrid resolves them, side by side."""
    g, p = pairs or entity_pairs(spark, d)
    listed = listed or terms(spark, d)
    every = Scratch(spark, "modes").save(X.dictionary_entities(docs(spark, d), listed), "dictionary")
    found = every.select("doc_id", "start", "end", F.col("category").alias("label"))
    hybrid = X.extract(docs(spark, d), p.withColumnRenamed("label", "category"), listed, found=every)[0].select("doc_id", "start", "end", F.col("category").alias("label"))
    parts = {"transformer_only": p, "confident": p.where("confidence >= 0.8D"), "entity_ruler_only": found, "hybrid": hybrid}
    out = None
    for mode, preds in parts.items():
        c = M.strict_counts(g, preds).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).withColumn("mode", F.lit(mode))
        out = c if out is None else out.unionByName(c)
    return M.by_mode(out)


QUERIES["mode_comparison"] = mode_comparison
from .queries_dictionary import ENTITIES_SQL  # noqa: E402

def rounded_report(spark, d):
    g, p = entity_pairs(spark, d)
    return M.strict_counts(g, p).select("label", *M.rounded_prf())


QUERIES["rounded_report"] = rounded_report
ORACLE_SQL["rounded_report"] = f"""WITH {TOK_SQL}, {PAIRS_SQL},
k AS (SELECT label, bool_or(side = 'g') AS g, bool_or(side = 'p') AS p FROM (SELECT doc_id, start, end_, label, 'g' AS side FROM gold UNION ALL SELECT doc_id, start, end_, category, 'p' FROM ml) GROUP BY doc_id, start, end_, label),
c AS (SELECT label, count(*) FILTER (WHERE g AND p)::DOUBLE AS tp, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE g) AS ng FROM k GROUP BY label),
r AS (SELECT label, round(100 * (tp / np), 2) AS precision, round(100 * (tp / ng), 2) AS recall FROM c)
SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 2) AS f1 FROM r"""
QUERIES["condition_grid"] = lambda spark, d: M.condition_grid(table(spark, d, "documents").select(F.col("lang").alias("condition")).distinct(), 5)
ORACLE_SQL["condition_grid"] = "SELECT condition, CAST(fold AS INTEGER) AS fold FROM (SELECT DISTINCT lang AS condition FROM documents), (SELECT unnest(range(5)) AS fold)"


def fold_pools(spark, d):
    """Pools of each of five folds: real documents, all of them with their number added as paraphrases, turns as generated texts; sizes and removals."""
    real = docs(spark, d).select("doc_id", "text")
    folds = Scratch(spark, "folds").save(P.stratified_folds(docs(spark, d).select("doc_id", "lang"), "lang", 5).select("doc_id", "fold"))
    para = real.select(T.source_id("text").alias("source_id"), F.col("doc_id").alias("para_id"), F.col("text").alias("source_text"), F.concat_ws(" ", "text", F.col("doc_id").cast("string")).alias("text"))
    alike, out = P.like_paraphrases(real, para, Scratch(spark, "folds")), None
    for fold in range(5):
        pool, removed, _ = P.fold_pools(real, folds, fold, para, table(spark, d, "conversations").select("text"), alike)
        a = pool.groupBy(F.col("pool").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        both = a.unionByName(removed.groupBy(F.concat(F.lit("removed_by_"), "reason").alias("part")).agg(F.count(F.lit(1)).alias("n"))).select(F.lit(fold).alias("fold"), "part", "n")
        out = both if out is None else out.unionByName(both)
    return out


QUERIES["fold_pools"] = fold_pools


def make_folds(spark, d):
    """Sizes of all parts of five folds: documents without near-exact copies, those of every third with a word changed as paraphrases, turns as generated texts."""
    own = docs(spark, d).select("doc_id", "text", "lang")
    para = own.where("doc_id % 3 = 0").select(T.source_id("text").alias("source_id"), F.col("doc_id").alias("para_id"), F.col("text").alias("source_text"), F.concat(F.lit("Besides, "), "text").alias("text"))
    return P.make_folds(own, F.col("lang"), para, table(spark, d, "conversations").select("text"))[2]


QUERIES["make_folds"] = make_folds


def learnable(spark, d, scratch):
    """Annotations that a tagger can learn: the dictionary's places in all documents."""
    return scratch.save(D.find_term_spans(D.dealt_out(docs(spark, d).select("doc_id", "text")), terms(spark, d)).select("doc_id", "start", "end", "label"), "gold")


def cv_report(spark, d):
    """Held-out metrics of taggers by condition (documents as they are, a tenth of them in lower case), fold and label; folds are stratified by language."""
    scratch = Scratch(spark, "cv")
    own = docs(spark, d).select("doc_id", "text")
    folds = scratch.save(P.stratified_folds(docs(spark, d).select("doc_id", "lang"), "lang", 3).select("doc_id", "fold"), "folds")
    counts = G.cross_validate({"real": own, "lowered": V.some_lowered()}, learnable(spark, d, scratch), folds, ("IT_TERM", "CLERICAL_TERM"), f"{scratch.root}/models", scratch, epochs=2)
    return counts.select("condition", "fold", "label", "tp", "fp", "fn", *M.prf())


QUERIES["cv_report"] = cv_report


def tagger_entities(spark, d):
    """Spans in all documents of a tagger taught on four fifths of them, with the confidence of its best decodings and whether the document was held out."""
    scratch = Scratch(spark, "tagger")
    own, gold = docs(spark, d).select("doc_id", "text"), learnable(spark, d, scratch)
    model = G.train(own.where("doc_id % 5 <> 0"), gold.where("doc_id % 5 <> 0"), ("IT_TERM", "CLERICAL_TERM"), scratch, epochs=2)
    return G.predict(own, model, scratch).withColumn("held_out", F.col("doc_id") % 5 == 0)


QUERIES["tagger_entities"] = tagger_entities
QUERIES["tagged_union"] = lambda spark, d: K.tag_union({"documents": docs(spark, d).select("text"), "turns": table(spark, d, "conversations").select("text", "role")}).groupBy("augmentation_type").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("with_role"))
ORACLE_SQL["tagged_union"] = "SELECT 'documents' AS augmentation_type, count(*) AS n, 0 AS with_role FROM documents UNION ALL SELECT 'turns', count(*), count(role) FROM conversations"
QUERIES["status_search"] = lambda spark, d: R.search(ml_spans(spark, d).withColumn("status", L.route("confidence")), "accepted", ["term", "status"]).select("doc_id", "start")
ORACLE_SQL["status_search"] = f"WITH {TOK_SQL}, {PAIRS_SQL} SELECT doc_id, start FROM ml WHERE contains(lower(term), 'accepted') OR confidence >= 0.8::DOUBLE"


#: The stand-in model's spans are 17 tokens apart, so none merges with its neighbour.
QUERIES["extract_model_only"] = lambda spark, d: X.extract(docs(spark, d), ml_spans(spark, d), terms(spark, d), mode="transformer_only")[0]
ORACLE_SQL["extract_model_only"] = ORACLE_SQL["model_entities"]

#: The hybrid in SQL: model spans trimmed without the dictionary, conflicts as in RESOLVED_SQL, neighbours folded in order, trimmed once more.
_words = "list_filter(string_split_regex(term, '\\s+'), lambda x: x <> '')"
_ML = RESOLVED_SQL[RESOLVED_SQL.index("m AS (SELECT") : RESOLVED_SQL.index("j AS (SELECT d.doc_id")]
_TRIMMED_ML = TRIMMED[TRIMMED.index("lw AS (SELECT") :].replace("lower(term) IN (SELECT term FROM terms) AS safe", "false AS safe") + ", m AS (SELECT * FROM me), "
ORACLE_SQL["extract_hybrid"] = rf"""WITH {RESOLVED_SQL.replace(_ML, _TRIMMED_ML)},
nb AS MATERIALIZED (SELECT r.*, text[lag(end_) OVER w + 1:start] AS gap FROM resolved r JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start, end_)),
fl AS (SELECT doc_id, list({{'s': start, 'e': end_, 'c': category, 'p': confidence::DOUBLE, 'o': source, 't': term, 'g': gap}} ORDER BY start, end_) AS h FROM nb GROUP BY doc_id),
fd AS (SELECT doc_id, list_reduce(list_transform(h, lambda x: [x]), lambda a, y: CASE WHEN a[-1].c = y[1].c AND trim(y[1].g, E' 
	
') = '' AND lower(trim(y[1].t)) NOT IN {TRAILING_TRIM} AND lower(trim(a[-1].t)) NOT IN {LEADING_TRIM}
       THEN list_concat(a[:-2], [{{'s': a[-1].s, 'e': y[1].e, 'c': y[1].c, 'p': round(least(a[-1].p, y[1].p), 4), 'o': CASE WHEN 'ML' IN (a[-1].o, y[1].o) THEN 'ML' ELSE 'dictionary' END, 't': a[-1].t || y[1].g || y[1].t, 'g': a[-1].g}}])
       ELSE list_concat(a, y) END) AS k FROM fl),
mg AS (SELECT doc_id, k.s AS start, k.e AS end_, k.c AS category, k.p AS confidence, k.o AS source, k.t AS term FROM (SELECT doc_id, unnest(k) AS k FROM fd)),
w0 AS (SELECT *, lower(trim(term)) IN (SELECT term FROM terms) AS safe, {_words} AS w FROM mg),
w1 AS (SELECT *, list_transform(w, lambda x: trim(lower(x), '.,:;!?()''"')) AS b, len(w) AS n FROM w0),
w2 AS (SELECT *, least(coalesce(list_position(list_transform(b, lambda x: NOT list_contains({list(LEADING_TRIM)}, x)), true), n + 1) - 1, n - 1) AS a FROM w1),
w3 AS (SELECT *, least(coalesce(list_position(list_transform(list_reverse(b[a + 1:]), lambda x: NOT list_contains({list(TRAILING_TRIM)}, x)), true), n - a + 1) - 1, n - a - 1) AS z FROM w2),
w4 AS (SELECT *, CASE WHEN safe OR a = 0 THEN '' ELSE regexp_extract(term, '^(\S+\s+){{' || a || '}}') END AS head FROM w3),
w5 AS (SELECT *, CASE WHEN safe OR z = 0 THEN substring(term, length(head) + 1) ELSE regexp_replace(substring(term, length(head) + 1), '(\s+\S+){{' || z || '}}$', '') END AS kept FROM w4)
SELECT doc_id, start + length(head) AS start, CASE WHEN safe THEN end_ ELSE start + length(head) + length(kept) END AS "end", kept AS term, category, confidence, source, CASE WHEN confidence >= 0.8::DOUBLE THEN 'ACCEPTED' ELSE 'NEEDS_REVIEW' END AS status
FROM w5 WHERE safe OR NOT (n - a - z = 1 AND (list_contains({list(LEADING_TRIM)}, b[a + 1]) OR list_contains({list(TRAILING_TRIM)}, b[a + 1])) AND kept <> upper(kept))"""

ORACLE_SQL["mode_comparison"] = f"""WITH {ENTITIES_SQL}, {PAIRS_SQL},
pr AS (SELECT 'transformer_only' AS mode, doc_id, start, end_, category AS label FROM ml UNION ALL SELECT 'confident', doc_id, start, end_, category FROM ml WHERE confidence >= 0.8::DOUBLE
       UNION ALL SELECT 'entity_ruler_only', doc_id, start, end_, label FROM dict WHERE NOT (lower(term) = 'with' AND term <> upper(term))
       UNION ALL SELECT 'hybrid', doc_id, start, "end", category FROM ({ORACLE_SQL["extract_hybrid"]})),
c AS (SELECT mode, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = pr.doc_id AND g.start = pr.start AND g.end_ = pr.end_ AND g.label = pr.label)) AS tp, count(*) AS n FROM pr GROUP BY mode),
t AS (SELECT mode, tp, n - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn FROM c),
m AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM t)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, recall - (SELECT recall FROM m WHERE mode = 'entity_ruler_only') AS recall_lift FROM m"""


def full_report(spark, d):
    """Strict counts, counts by mode and holdout counts by status in one table."""
    from .queries_resolve import holdout, strict_prf

    pairs, listed = entity_pairs(spark, d), terms(spark, d)  # all three read the same spans and terms
    return M.full_report(strict_prf(spark, d, pairs), mode_comparison(spark, d, pairs, listed), holdout(spark, d, pairs, listed))


QUERIES["full_report"] = full_report
from .queries_resolve import ORACLE_SQL as RESOLVE_SQL  # noqa: E402

ORACLE_SQL["full_report"] = f"""SELECT 'strict' AS section, label AS name, tp, fp, fn, precision, recall, f1 FROM ({RESOLVE_SQL["strict_prf"]})
UNION ALL SELECT 'mode', mode, tp, fp, fn, precision, recall, f1 FROM ({ORACLE_SQL["mode_comparison"]}) UNION ALL SELECT 'holdout', term_status, tp, NULL, fn, NULL, recall / 100, NULL FROM ({RESOLVE_SQL["holdout_by_status"]})"""


def prepared(spark, d):
    """Documents split by shared sentences, with their annotations at token ends: annotated documents and spans of each split."""
    split, spans = P.prepare(docs(spark, d).select("doc_id", "text"), gold_spans(spark, d).select("doc_id", "start", "end", "label"), Scratch(spark, "prepare"))
    both = spans.join(split.select("doc_id", "split"), "doc_id")
    return both.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.sum(F.col("end") - F.col("start")).alias("chars"))


QUERIES["prepared"] = prepared
QUERIES["extract_dictionary_only"] = lambda spark, d: X.extract(docs(spark, d), None, terms(spark, d), mode="entity_ruler_only")[0].select("doc_id", "start", "end", "term", "category", "confidence", "source", "status")
_after = ORACLE_SQL["extract_hybrid"][ORACLE_SQL["extract_hybrid"].index("nb AS MATERIALIZED") :]
ORACLE_SQL["extract_dictionary_only"] = f"""WITH {ENTITIES_SQL}, resolved AS (SELECT doc_id, start, end_, term, label AS category, 1.0::DOUBLE AS confidence, 'dictionary' AS source FROM dict
WHERE NOT (lower(term) IN {TRAILING_TRIM} AND term <> upper(term))), {_after}"""
QUERIES["failed_responses"] = lambda spark, d: Y.failed_responses(docs(spark, d).select("doc_id", F.col("text").alias("raw")), "doc_id")
ORACLE_SQL["failed_responses"] = """SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty' ELSE 'no_json' END AS reason FROM documents"""
