"""Extraction over a stream of documents, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import ACCEPT_FROM
from ..functions.text import is_blank
from ..operators.resolve import extract
from ..operators.summary import batch_rows, deduplicate_entities, summarise

LONGEST = 100_000


def guard(docs: DataFrame, longest: int = LONGEST, text: str = "text") -> DataFrame:
    """docs with a reject_reason: blank texts and texts over the limit are not processed."""
    return docs.withColumn("reject_reason", F.when(is_blank(text), "blank").when(F.length(text) > longest, "too_long"))


def batch_run(docs: DataFrame, preds: DataFrame | None, terms: DataFrame, accept_from: float = ACCEPT_FROM, longest: int = LONGEST, key: str = "doc_id") -> DataFrame:
    """(key, error, occurrences, a column for each label, review) of every document: a text that is rejected has an error and no counts, and ends nothing."""
    marked = guard(docs, longest)
    ok = marked.where("reject_reason is null").drop("reject_reason")
    found, _ = extract(ok, preds, terms, "entity_ruler_only" if preds is None else "hybrid", accept_from, key)
    counts = batch_rows(found, key)
    out = marked.select(key, F.col("reject_reason").alias("error")).join(counts, key, "left")
    return out.select(key, "error", *[F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in counts.columns if c != key])


def responses(docs: DataFrame, entities: DataFrame, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, response): what a request for each document is answered, as JSON: its unique entities with their summary, or why it was rejected."""
    unique = deduplicate_entities(entities, key)
    fields = [c for c in unique.columns if c not in (key, "start")]
    e = unique.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", *fields))).alias("entities"))
    s = summarise(unique, key)
    s = s.select(key, F.struct(*[c for c in s.columns if c != key]).alias("summary"))
    out = guard(docs, longest, text).select(key, F.col(text).alias("content"), F.col("reject_reason").alias("error")).join(e, key, "left").join(s, key, "left")
    body = F.struct(F.col("error").isNull().alias("success"), "error", "content", F.coalesce("entities", F.array().cast(e.schema["entities"].dataType)).alias("entities"), F.coalesce(F.size("entities"), F.lit(0)).alias("entity_count"), "summary")
    return out.select(key, F.to_json(body).alias("response"))


def extract_stream(docs: DataFrame, terms: DataFrame, out: str, preds: DataFrame | None = None, accept_from: float = ACCEPT_FROM, checkpoint: str | None = None):
    """Start a query that writes each document's unique entities as Parquet below out.

    Each micro-batch goes through the same code as a batch: nothing is kept between documents, so there is no state and no
    watermark. Returns the StreamingQuery.
    """

    def one(batch: DataFrame, number: int) -> None:
        ok = guard(batch).where("reject_reason is null").drop("reject_reason")
        mode = "entity_ruler_only" if preds is None else "hybrid"
        found, _ = extract(ok, preds, terms, mode, accept_from)
        deduplicate_entities(found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(one).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    """Documents from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
