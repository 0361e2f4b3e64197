"""Sinks: JSON lines, span tables, reports, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines; null fields are left out."""
    df.write.mode(mode).json(path)


def write_spans(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Annotated records as Parquet, the columnar form of a document store."""
    records.write.mode(mode).parquet(path)


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row of a small result as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append_events(events: DataFrame, path: str, extra: str | None = None) -> None:
    """Append events to the main log, and to another one if it differs."""
    for p in dict.fromkeys([path, extra or path]):
        events.write.mode("append").json(p)


def write_evaluation(items: DataFrame, path: str) -> None:
    """All items, and those with any result that is not correct."""
    items.write.mode("overwrite").json(f"{path}/all")
    items.where(F.exists("entity_results", lambda r: r["status"] != "correct")).write.mode("overwrite").json(f"{path}/errors")


def report_document(df: DataFrame, name: str = "report") -> DataFrame:
    """A small result as one JSON document: an array of its rows, in their order as texts."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns))))).alias(name))


def run_path(root: str, kind: str, label: str | None = None, stamp: str | None = None) -> str:
    """Where the outputs of a run go: a folder for each label, or else for each time stamp."""
    return "/".join([root.rstrip("/"), kind, label or f"run_{stamp}"])


def export_records(docs: DataFrame, entities: DataFrame, summary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, entities, summary) of each document, as batches are exported: its entities by start, its summary or null."""
    fields = [c for c in entities.columns if c != key]
    e = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", *[c for c in fields if c != "start"]))).alias("entities"))
    s = summary.select(key, F.struct(*[c for c in summary.columns if c != key]).alias("summary"))
    out = docs.select(key, text).join(e, key, "left").join(s, key, "left")
    return out.select(key, F.col(text).alias("text"), F.coalesce("entities", F.array().cast(e.schema["entities"].dataType)).alias("entities"), "summary")


def save_settings(spark, path: str, terms: DataFrame, settings: dict[str, str]) -> None:
    """The dictionary and the settings of an extractor, beside its model."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame(sorted((k, str(v)) for k, v in settings.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
