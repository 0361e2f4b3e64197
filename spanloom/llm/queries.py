"""The queries opN_<name> over the driver tables, their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, embed_dedup, exact_dedup, filter_audit, langid, main_text, mixing, near_dedup, quality, secrets, substring_dedup, toxicity
from .common import Scratch, crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its group of equal texts and whether it stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_dedup.duplicate_groups(docs, Scratch(spark, "op1"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = mixing.Mix(docs).taken()
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from three quarters of the labelled documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = quality.score(docs, model, [F.col("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on shingles of two words: each document's component and whether it stays."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, Scratch(spark, "op4"), size=2, percent=80).drop("th")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
d AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, d.v FROM r JOIN d ON d.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from four fifths of the labelled documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(docs, model, [F.col("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between embeddings of one label, and which of each component stays."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embed_dedup.near_vectors(vectors, Scratch(spark, "op6"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, d.v FROM r JOIN d ON d.u = r.v),
m AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM d GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from four fifths of the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, crc_mod("doc_id", 5) != 0)
    keep = [F.col("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out")]
    return langid.identify(docs, model, keep).select("doc_id", "held_out", "lang_pred", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts and places."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids and back; digests of both."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, ["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text when passages of 35 words that occur twice are taken out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring_dedup.remove_repeats(docs, Scratch(spark, "op10"), size=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM x),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g JOIN r USING (g)),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels"), Scratch(spark, "op11"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components after three rounds."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.clusters(vectors, Scratch(spark, "op12")).withColumnRenamed("id", "vec_id")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, [F.col("page_id"), F.col("url")], main_text.train(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_quality": op3_quality,
        "op4_near_dedup": op4_near_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_language_id": op7_language_id,
        "op8_secret_scan": op8_secret_scan,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_html_text": op13_html_text,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op4_near_dedup": OP4_SQL,
        "op6_embedding_dedup": OP6_SQL,
        "op8_secret_scan": secrets.digest_sql(),
        "op10_substring_dedup": OP10_SQL,
        "op11_filter_audit": filter_audit.AUDIT_SQL,
        "op12_centroid_clusters": centroids.clusters_sql(),
    }
