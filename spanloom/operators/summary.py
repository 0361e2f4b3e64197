"""Per-document entity summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NEEDS_REVIEW, SPAN_LABELS, percentage
from ..functions.text import normalise


def deduplicate_entities(entities: DataFrame, key: str = "doc_id", order: str = "start") -> DataFrame:
    """One row for each (document, normalised term, category): its first entity, with frequency."""
    e = entities.withColumn("_norm", normalise("term"))
    rest = [c for c in entities.columns if c not in (key, "category")]
    e = e.groupBy(key, "_norm", "category").agg(F.min_by(F.struct(*rest), F.struct(order, "end")).alias("f"), F.count(F.lit(1)).alias("frequency"))
    return e.select(key, "category", *[F.col(f"f.{c}").alias(c) for c in rest], "frequency")


def summarise(unique: DataFrame, key: str = "doc_id", labels: tuple[str, ...] = SPAN_LABELS) -> DataFrame:
    """Occurrences, unique entities, and each label's unique count and percentage (one decimal)."""
    per = [F.count_if(F.col("category") == x).alias(x) for x in labels]
    s = unique.groupBy(key).agg(F.sum("frequency").alias("total_occurrences"), F.count(F.lit(1)).alias("unique_entities"), *per)
    return s.select("*", *[percentage(x, "unique_entities", 1).alias(f"{x}_percentage") for x in labels])


def review_flag(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether any entity of a document needs review."""
    return entities.groupBy(key).agg(F.bool_or(F.col("status") == NEEDS_REVIEW).alias("has_review_items"))


def batch_rows(entities: DataFrame, key: str = "doc_id", labels: tuple[str, ...] = SPAN_LABELS) -> DataFrame:
    """Per document: occurrences, each label's occurrences, and entities to review."""
    return entities.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"), *[F.count_if(F.col("category") == x).alias(x) for x in labels], F.count_if(F.col("status") == NEEDS_REVIEW).alias("review"))


def filter_entities(entities: DataFrame, term: str | None = None, category: str | None = None, status: str | None = None, source: str | None = None) -> DataFrame:
    """Entities that satisfy all conditions given; term is a part of the term in any case."""
    out = entities if term is None else entities.where(F.contains(F.lower("term"), F.lit(term.lower())))
    for name, value in (("category", category), ("status", status), ("source", source)):
        out = out if value is None else out.where(F.col(name) == value)
    return out
