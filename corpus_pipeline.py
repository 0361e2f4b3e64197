"""A corpus pipeline of five stages over the table documents; counted as part of the subpackage spanloom.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() applies them one after the other. All but the last
return the columns of documents, as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from spanloom.llm import bpe, exact_dedup, langid, mixing, near_dedup
from spanloom.llm.common import Scratch, crc_mod, quoted

#: A document is rejected if its main language covers less than this part of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose letters no single language covers by half, go."""
    model = langid.train(docs, crc_mod("doc_id", 5) != 0)
    own = {f"own_{i}": c for i, c in enumerate(docs.columns)}
    labelled = langid.identify(docs, model, [F.col(quoted(c)).alias(k) for k, c in own.items()])
    stay = labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE))
    return stay.select(*[F.col(k).alias(c) for k, c in own.items()])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 of their five-word shingles, the one with the smallest doc_id stays."""
    return near_dedup.keep_first(docs, Scratch(spark, "pipeline-near"), size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents in the words that the mix takes, once for each pass that takes any."""
    return mixing.Mix(docs).documents()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as byte-level BPE ids (little-endian unsigned 32-bit integers), with the text decoded from them."""
    coded = bpe.encode_decode(docs, ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"), F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: The language model, the mix's permutations and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
