"""Queries over dedup, leakage, splits and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.text import SPACE, TOKEN, WORD_RUN
from ..operators import dedup as D
from ..operators import leakage as K
from ..operators import similarity as S
from ..operators import split as P
from ..operators.scratch import Scratch
from ..sources.tables import table
from .inputs import PAIRS_SQL, TERMS_SQL, TOK_SQL, docs, gold_spans, terms
from .queries_dictionary import ENTITIES_SQL, HITS_SQL
from .queries_text import COLLAPSE, STRIP

QUERIES, ORACLE_SQL = {}, {}


def _first(key: str, where: str = "true") -> str:
    return f"SELECT min(doc_id) AS doc_id FROM documents WHERE {where} GROUP BY {key}"


BLANK = f"{STRIP} <> ''"
QUERIES["dedup_exact"] = lambda spark, d: D.deduplicate_records(docs(spark, d), "doc_id").select("doc_id")
ORACLE_SQL["dedup_exact"] = _first(STRIP, BLANK)
QUERIES["dedup_normalized"] = lambda spark, d: D.deduplicate_normalised(docs(spark, d), "doc_id").select("doc_id")
ORACLE_SQL["dedup_normalized"] = _first(f"lower({COLLAPSE})")
QUERIES["dedup_collapsed"] = lambda spark, d: D.deduplicate_collapsed(docs(spark, d), "doc_id").select("doc_id")
ORACLE_SQL["dedup_collapsed"] = _first(COLLAPSE)
QUERIES["dedup_accepted"] = lambda spark, d: D.deduplicate_accepted(docs(spark, d), F.col("doc_id") % 3 != 0, "doc_id").select("doc_id")
ORACLE_SQL["dedup_accepted"] = _first(f"lower({STRIP})", "doc_id % 3 <> 0")


def labelled(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")


LABELLED = "l AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
QUERIES["dup_conflicts"] = lambda spark, d: D.conflicts(labelled(spark, d), "doc_id", "quality")
CONFLICTS = f"k AS (SELECT doc_id, quality, first_value(doc_id) OVER w AS ko, first_value(quality) OVER w AS kq FROM l WHERE {BLANK} WINDOW w AS (PARTITION BY {STRIP} ORDER BY doc_id))"
ORACLE_SQL["dup_conflicts"] = f"WITH {LABELLED}, {CONFLICTS} SELECT ko AS kept, doc_id AS other, kq AS kept_value, quality AS other_value FROM k WHERE doc_id > ko AND quality IS DISTINCT FROM kq"
QUERIES["dedup_stats"] = lambda spark, d: D.dedup_stats(labelled(spark, d), "doc_id", "quality")
ORACLE_SQL["dedup_stats"] = f"WITH {LABELLED}, {CONFLICTS} SELECT (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l WHERE NOT {BLANK}) AS blank, (SELECT count(DISTINCT ko) FROM k) AS kept, (SELECT count(*) FROM k WHERE doc_id > ko) AS duplicates, (SELECT count(*) FROM k WHERE doc_id > ko AND quality IS DISTINCT FROM kq) AS conflicts"


def parts(spark, d):
    """Documents dealt to three splits by id."""
    return docs(spark, d).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")))


PARTS = "p AS (SELECT *, (['train', 'dev', 'test'])[doc_id % 3 + 1] AS split FROM documents)"
SHARED = "m AS (SELECT DISTINCT a.split AS a, b.split AS b, a.u FROM u a JOIN u b ON a.u = b.u AND a.split < b.split) SELECT a, b, count(*) AS n_shared FROM m GROUP BY a, b"
QUERIES["duplicates_within"] = lambda spark, d: D.duplicates_within(parts(spark, d), "split")
ORACLE_SQL["duplicates_within"] = f"WITH {PARTS} SELECT split, count(*) - count(DISTINCT CASE WHEN {BLANK} THEN {STRIP} END) AS duplicates FROM p GROUP BY split"
QUERIES["split_overlap_docs"] = lambda spark, d: K.split_overlap(parts(spark, d).where(~T.is_blank("text")), "split", F.array(T.strip("text")))
ORACLE_SQL["split_overlap_docs"] = f"WITH {PARTS}, u AS (SELECT split, {STRIP} AS u FROM p WHERE {BLANK}), {SHARED}"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> '')"
QUERIES["split_overlap_sentences"] = lambda spark, d: K.split_overlap(parts(spark, d), "split", T.sentences("text"))
ORACLE_SQL["split_overlap_sentences"] = f"WITH {PARTS}, u AS (SELECT split, unnest({SENTENCES}) AS u FROM p), {SHARED}"

QUERIES["components"] = lambda spark, d: P.sentence_components(docs(spark, d), Scratch(spark, "components"))
ORACLE_SQL["components"] = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(list_distinct({SENTENCES})) AS s FROM documents),
h AS (SELECT s, min(doc_id) AS hub FROM s GROUP BY s), e AS (SELECT DISTINCT doc_id AS u, hub AS v FROM s JOIN h USING (s) WHERE doc_id <> hub), d AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, d.v FROM r JOIN d ON d.u = r.v)
SELECT u AS doc_id, min(v) AS component FROM r GROUP BY u"""
QUERIES["component_split"] = lambda spark, d: P.component_split(docs(spark, d), Scratch(spark, "split"), "doc_id")
ORACLE_SQL["component_split"] = f"""WITH RECURSIVE own AS (SELECT min(doc_id) AS doc_id FROM documents WHERE {BLANK} GROUP BY {STRIP}), s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({SENTENCES})) AS s FROM documents JOIN own USING (doc_id)),
h AS (SELECT s, min(doc_id) AS hub FROM s GROUP BY s), e AS (SELECT DISTINCT doc_id AS u, hub AS v FROM s JOIN h USING (s) WHERE doc_id <> hub), d AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM own UNION SELECT r.u, d.v FROM r JOIN d ON d.u = r.v),
c AS MATERIALIZED (SELECT u AS doc_id, min(v) AS component FROM r GROUP BY u),
z AS MATERIALIZED (SELECT component, n, row_number() OVER (ORDER BY md5('42:' || component), component) AS i, (SELECT CAST(floor(count(*) * 0.70::DOUBLE) AS BIGINT) FROM c) AS a, (SELECT CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) FROM c) AS b FROM (SELECT component, count(*) AS n FROM c GROUP BY component)),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS x, 0::BIGINT AS y, NULL::BIGINT AS component, '' AS split
      UNION ALL SELECT z.i, x + CASE WHEN k = 'train' THEN n ELSE 0 END, y + CASE WHEN k = 'dev' THEN n ELSE 0 END, z.component, k FROM f JOIN z ON z.i = f.i + 1,
      LATERAL (SELECT CASE WHEN x + n <= a OR (y >= b AND x < a) THEN 'train' WHEN y + n <= b THEN 'dev' ELSE 'test' END AS k))
SELECT doc_id, component, split FROM c JOIN f USING (component)"""


def strat_folds(spark, d):
    x = labelled(spark, d)
    ls = F.filter(F.array(F.when(F.col("quality") == 0, "IT_TERM"), F.when(F.col("toxic") == 1, "CLERICAL_TERM")), lambda y: y.isNotNull())
    return P.stratified_folds(x.select("doc_id", L.class_of(ls).alias("stratum")), "stratum", 5)


QUERIES["strat_folds"] = strat_folds
ORACLE_SQL["strat_folds"] = f"""WITH {LABELLED}, s AS (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'it_only' WHEN toxic = 1 THEN 'cl_only' ELSE 'negative' END AS stratum FROM l)
SELECT doc_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM s"""
QUERIES["seeded_sample"] = lambda spark, d: P.seeded_sample(docs(spark, d).select("doc_id", "lang"), "lang", 15)
ORACLE_SQL["seeded_sample"] = "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 15"

QUERIES["contamination_exact"] = lambda spark, d: docs(spark, d).join(K.protected_texts([table(spark, d, "benchmark"), table(spark, d, "conversations")]), T.lower_strip("text") == F.col("key"), "left_semi").select("doc_id")
ORACLE_SQL["contamination_exact"] = f"SELECT doc_id FROM documents WHERE lower({STRIP}) IN (SELECT lower({STRIP}) FROM benchmark UNION SELECT lower({STRIP}) FROM conversations)"
QUERIES["exclude_protected"] = lambda spark, d: K.exclude(table(spark, d, "conversations").select("conv_id", "turn", "text"), K.protected_texts([docs(spark, d), table(spark, d, "benchmark")]), T.lower_strip("text")).select("conv_id", "turn")
ORACLE_SQL["exclude_protected"] = f"SELECT conv_id, turn FROM conversations WHERE lower({STRIP}) NOT IN (SELECT lower({STRIP}) FROM documents UNION SELECT lower({STRIP}) FROM benchmark)"
QUERIES["contamination_contains"] = lambda spark, d: K.contained_items(docs(spark, d), table(spark, d, "benchmark"), "item_id")
ORACLE_SQL["contamination_contains"] = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"
QUERIES["terms_in_texts"] = lambda spark, d: K.terms_in_texts(table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), terms(spark, d))
ORACLE_SQL["terms_in_texts"] = rf"WITH {TERMS_SQL} SELECT DISTINCT item_id AS doc_id, term FROM benchmark JOIN terms ON regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])')"


def sentences_of(df, key):
    return df.select(key, F.explode(F.array_distinct(T.sentences("text"))).alias("text"))


def near_dup_jaccard(spark, d):
    """Document sentences like a benchmark sentence by their words."""
    left = sentences_of(docs(spark, d), "doc_id").select("doc_id", "text").withColumn("left_id", F.struct("doc_id", "text"))
    right = sentences_of(table(spark, d, "benchmark"), "item_id").withColumn("right_id", F.struct("item_id", "text"))
    p = K.word_jaccard_pairs(left, right, 0.6, "left_id", "right_id")
    return p.select("left_id.doc_id", "right_id.item_id", F.md5(F.col("left_id.text").cast("binary")).alias("doc_sentence"), F.md5(F.col("right_id.text").cast("binary")).alias("item_sentence"), "jaccard")


QUERIES["near_dup_jaccard"] = near_dup_jaccard
ORACLE_SQL["near_dup_jaccard"] = f"""WITH a AS (SELECT DISTINCT doc_id, unnest({SENTENCES}) AS s FROM documents), b AS (SELECT DISTINCT item_id, unnest({SENTENCES}) AS t FROM benchmark),
x AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '{WORD_RUN}')) AS lw FROM a), y AS (SELECT *, list_distinct(regexp_extract_all(lower(t), '{WORD_RUN}')) AS rw FROM b),
z AS (SELECT doc_id, item_id, s, t, len(list_intersect(lw, rw)) AS k, len(lw) + len(rw) AS n FROM x JOIN y ON len(lw) > 0 AND len(rw) > 0 AND len(lw) >= 0.6 * len(rw) AND len(rw) >= 0.6 * len(lw))
SELECT doc_id, item_id, md5(s) AS doc_sentence, md5(t) AS item_sentence, k / (n - k)::DOUBLE AS jaccard FROM z WHERE k / (n - k)::DOUBLE >= 0.6"""
QUERIES["near_dup_ratio"] = lambda spark, d: S.ratio_pairs(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"), 0.7, "doc_id", "item_id")
QUERIES["near_dup_turns"] = lambda spark, d: S.ratio_pairs(table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("turn_id"), "text"), table(spark, d, "benchmark"), 0.7, "turn_id", "item_id").select("turn_id.conv_id", "turn_id.turn", "item_id", "ratio")


def near_dup_sentences(spark, d):
    """Document sentences with a near-duplicate among the benchmark's sentences, by words, then by sequence ratio."""
    left = sentences_of(docs(spark, d), "doc_id").withColumn("left_id", F.struct("doc_id", "text"))
    right = sentences_of(table(spark, d, "benchmark"), "item_id").withColumn("right_id", F.struct("item_id", "text"))
    found = S.word_then_ratio(left, right, "left_id", "right_id")
    return found.select("left_id.doc_id", F.md5(F.col("left_id.text").cast("binary")).alias("sentence"), "right_id.item_id", "ratio")


QUERIES["near_dup_sentences"] = near_dup_sentences


def annotated_terms(spark, d):
    """Dictionary terms that equal an annotated surface."""
    return K.covered_terms(terms(spark, d), gold_spans(spark, d)).select("term")


QUERIES["annotated_terms"] = annotated_terms
ORACLE_SQL["annotated_terms"] = f"WITH {TOK_SQL}, {TERMS_SQL}, {PAIRS_SQL} SELECT term FROM terms WHERE lower(term) IN (SELECT lower(term) FROM gold)"
QUERIES["matched_in_context"] = lambda spark, d: K.matched_in_context(gold_spans(spark, d), docs(spark, d), terms(spark, d)).select("doc_id", "start", "end", "label", "term")
ORACLE_SQL["matched_in_context"] = f"""WITH {ENTITIES_SQL}, {PAIRS_SQL} SELECT doc_id, start, end_ AS "end", label, term FROM gold g WHERE EXISTS (SELECT 1 FROM dict x WHERE x.doc_id = g.doc_id AND x.start = g.start AND x.end_ = g.end_ AND x.label = g.label AND x.term = g.term AND NOT (lower(x.term) = 'with' AND x.term <> upper(x.term)))"""


def marked_benchmark(spark, d):
    """The benchmark with a term for each item: the longest word of its text, the first of equals."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 4)
    best = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return table(spark, d, "benchmark").select("item_id", "text", F.get(best, F.lit(0))["x"].alias("term"))


MARKED = "bm AS (SELECT item_id, text, (SELECT x FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x) WHERE length(x) >= 4 ORDER BY -length(x), x LIMIT 1) AS term FROM benchmark)"


def leakage_audit(spark, d):
    """All seven checks; holdout are the turns of users, the known pool the documents, generated texts the turns of assistants."""
    turns = table(spark, d, "conversations")
    checks = K.leakage_checks(parts(spark, d), "split", marked_benchmark(spark, d), terms(spark, d), gold_spans(spark, d), turns.where("role = 'user'").select("text"), docs(spark, d).select("text"), turns.where("role <> 'user'").select("text"))
    del checks["terms_in_context"]  # a query by itself
    checks["benchmark_in_train"] = K.contained_items(parts(spark, d).where("split = 'train'"), table(spark, d, "benchmark"), "item_id")
    return K.audit(checks, informational=("terms_annotated",)).select("check", "n", "passed", F.size("sample").cast("long").alias("n_sample"))


QUERIES["leakage_audit"] = leakage_audit
ORACLE_SQL["leakage_audit"] = rf"""WITH {PARTS}, {ENTITIES_SQL}, {PAIRS_SQL}, {MARKED}, u AS (SELECT DISTINCT split, {STRIP} AS u FROM p WHERE {BLANK}), su AS MATERIALIZED (SELECT DISTINCT split, unnest({SENTENCES}) AS u FROM p),
o(a, b) AS (VALUES ('train', 'dev'), ('train', 'test'), ('dev', 'test')), bt AS (SELECT DISTINCT term FROM bm WHERE term IS NOT NULL),
gt AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM conversations WHERE role <> 'user'),
x AS (SELECT 'shared_texts' AS "check", to_json({{'unit': y.u, 'between': a || ' ' || b}})::VARCHAR AS j FROM o JOIN u y ON y.split = a JOIN u z ON z.split = b AND z.u = y.u
UNION ALL SELECT 'shared_sentences', to_json({{'unit': y.u, 'between': a || ' ' || b}})::VARCHAR FROM o JOIN su y ON y.split = a JOIN su z ON z.split = b AND z.u = y.u
UNION ALL SELECT 'terms_in_dictionary', to_json({{'term': term}})::VARCHAR FROM bt WHERE term IN (SELECT term FROM terms)
UNION ALL SELECT 'terms_annotated', to_json({{'term': term}})::VARCHAR FROM bt WHERE term IN (SELECT lower(term) FROM gold)
UNION ALL SELECT 'holdout_in_known_pool', to_json({{'unit': h}})::VARCHAR FROM (SELECT DISTINCT unnest({SENTENCES}) AS h FROM conversations WHERE role = 'user') WHERE h IN (SELECT u FROM su)
UNION ALL SELECT 'benchmark_in_train', to_json({{'doc_id': p.doc_id, 'item_id': b.item_id}})::VARCHAR FROM p JOIN benchmark b ON contains(p.text, b.text) WHERE split = 'train'),
n AS (SELECT "check", count(*) AS n FROM x GROUP BY "check" UNION ALL SELECT 'terms_in_generated', count(*) FROM gt JOIN bt ON list_contains(t, term)),
names(c) AS (VALUES ('shared_texts'), ('shared_sentences'), ('terms_in_dictionary'), ('terms_annotated'), ('terms_in_generated'), ('holdout_in_known_pool'), ('benchmark_in_train'))
SELECT c AS "check", coalesce(n, 0) AS n, c = 'terms_annotated' OR coalesce(n, 0) = 0 AS passed, least(coalesce(n, 0), 5) AS n_sample FROM names LEFT JOIN n ON c = "check" """


def terms_in_context(spark, d):
    """Benchmark terms that the dictionary finds in the benchmark's own texts, with their places."""
    turns = table(spark, d, "conversations").select("text")
    return K.leakage_checks(parts(spark, d), "split", marked_benchmark(spark, d), terms(spark, d), gold_spans(spark, d), turns, turns, turns)["terms_in_context"]


QUERIES["terms_in_context"] = terms_in_context
ORACLE_SQL["terms_in_context"] = rf"""WITH {TERMS_SQL}, {MARKED}, bk AS (SELECT item_id, regexp_extract_all(text, '{TOKEN}') AS t, term AS bterm FROM bm),
b1 AS (SELECT item_id, bterm, unnest(t) AS tok, unnest(range(len(t))) AS idx FROM bk),
b2 AS (SELECT *, CAST(sum(length(tok)) OVER (PARTITION BY item_id ORDER BY idx) - length(tok) AS INTEGER) AS start, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2 FROM b1 WINDOW w AS (PARTITION BY item_id ORDER BY idx))
SELECT item_id, bterm AS term, start FROM b2 WHERE lower(tok) = bterm AND bterm IN (SELECT term FROM terms)
AND NOT coalesce(lower(tok || t1 || t2) IN (SELECT term FROM terms), false) AND NOT coalesce(lower(p2 || p1 || tok) IN (SELECT term FROM terms), false)"""


def fold_audit(spark, d):
    """Folds by number of the document; the other folds are trained on."""
    own = docs(spark, d).select("text", (F.col("doc_id") % 5).alias("fold"))
    others = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in range(5)]), lambda k: k != F.col("doc_id") % 5)).alias("fold")
    train = docs(spark, d).select(others, "text")
    surfaces = gold_spans(spark, d).select(others, "term").distinct()
    bench = marked_benchmark(spark, d)
    return K.fold_checks(own.select("fold", "text"), train, bench, table(spark, d, "conversations").select("text"), surfaces, terms(spark, d), bench.where("term is not null").select("term"))


QUERIES["fold_audit"] = fold_audit
ORACLE_SQL["fold_audit"] = f"""WITH {TOK_SQL}, {PAIRS_SQL}, {TERMS_SQL}, {MARKED}, f AS (SELECT unnest(range(5)) AS fold), v AS MATERIALIZED (SELECT DISTINCT doc_id % 5 AS fold, lower({STRIP}) AS k FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id % 5 AS fold, lower(term) AS k FROM gold WHERE lower(term) IN (SELECT term FROM bm)),
x AS (SELECT fold, 'validation_in_benchmark' AS "check", k FROM v WHERE k IN (SELECT lower({STRIP}) FROM benchmark)
UNION ALL SELECT fold, 'validation_in_test', k FROM v WHERE k IN (SELECT lower({STRIP}) FROM conversations)
UNION ALL SELECT DISTINCT v.fold, 'validation_in_train', v.k FROM v JOIN v t ON t.k = v.k AND t.fold <> v.fold
UNION ALL SELECT DISTINCT f.fold, 'terms_in_training', k FROM f JOIN g ON g.fold <> f.fold),
c("check") AS (VALUES ('validation_in_benchmark'), ('validation_in_test'), ('validation_in_train'), ('terms_in_training'))
SELECT f.fold, c."check", count(k) AS n, c."check" = 'validation_in_test' OR count(k) = 0 AS passed FROM f CROSS JOIN c LEFT JOIN x ON x.fold = f.fold AND x."check" = c."check" GROUP BY f.fold, c."check"
UNION ALL SELECT NULL, 'canonical_terms', count(*), count(*) = 0 FROM (SELECT DISTINCT term FROM bm WHERE term IN (SELECT term FROM terms))"""


def near_dup_audit(spark, d):
    """Documents and turns as the augmented pool, documents as the real one, the benchmark as evaluation texts."""
    own, turns = docs(spark, d).select("text"), table(spark, d, "conversations").select("text")
    return K.near_duplicate_audit(own.unionByName(turns), own, table(spark, d, "benchmark").select("text"))


QUERIES["near_dup_audit"] = near_dup_audit


def synthetic_part(spark, d):
    """Training rows that aren't real ones: odd documents against even ones, by normalised text."""
    return K.only_in(docs(spark, d).where("doc_id % 2 = 1"), docs(spark, d).where("doc_id % 2 = 0")).select("doc_id")


QUERIES["synthetic_part"] = synthetic_part
ORACLE_SQL["synthetic_part"] = f"SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND lower({COLLAPSE}) NOT IN (SELECT lower({COLLAPSE}) FROM documents WHERE doc_id % 2 = 0)"
