"""Scans: term dictionaries, JSON lines, raw texts, evaluation outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import is_blank, lower_strip, strip

SPAN = "struct<start:int,end:int,label:string,term:string>"
RECORD_SCHEMA = f"text string, entities array<{SPAN}>, augmentation_type string, source_text string, source_id string"


def order_terms(terms: DataFrame, names: Mapping[str, str] = L.TO_SPAN_LABEL) -> DataFrame:
    """(term, label, ord) from raw (term, label, idx): trimmed, labels mapped leniently, blank terms dropped.

    Of a repeated term the last label wins at the first position. ord runs from 1 by falling length, then position.
    """
    t = terms.select(strip("term").alias("term"), L.lenient_label(strip("label"), names).alias("label"), "idx").where("term <> ''")
    t = t.groupBy("term").agg(F.max_by("label", "idx").alias("label"), F.min("idx").alias("idx"))
    from pyspark.sql import Window

    return t.select("term", "label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.length("term").desc(), "idx")).alias("ord"))


def load_terms(spark: SparkSession, path: str, names: Mapping[str, str] = L.TO_SPAN_LABEL) -> DataFrame:
    """The dictionary of a CSV file with the header term,label."""
    rows = spark.read.option("header", True).csv(path).select("term", "label").withColumn("idx", F.monotonically_increasing_id())
    return order_terms(rows, names)


def terms_by_label(terms: DataFrame, labels: tuple[str, ...] = L.SPAN_LABELS) -> DataFrame:
    """(label, terms) for the known labels; others are dropped."""
    return terms.where(F.col("label").isin(*labels)).groupBy("label").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def known_terms(terms: DataFrame) -> DataFrame:
    """Distinct lower-cased terms without nulls."""
    return terms.where("term is not null").select(lower_strip("term").alias("term")).distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Strict JSON lines: blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_tolerant(lines: DataFrame, schema: str = RECORD_SCHEMA, comments: bool = True) -> DataFrame:
    """Records of a column value of JSON lines; blank and malformed lines, and comments after #, are skipped."""
    own = lines.where(~is_blank("value"))
    if comments:
        own = own.where(~F.startswith(strip("value"), F.lit("#")))
    parsed = own.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, comments: bool = True) -> DataFrame:
    return parse_tolerant(spark.read.text(path), schema, comments)


def validate_jsonl(lines: DataFrame) -> DataFrame:
    """(line, value, error) for a table (line, value): null, or why a line can't be opened as a record."""
    v = F.try_parse_json("value")
    entities = F.get_json_object("value", "$.entities")
    error = (
        F.when(v.isNull(), "malformed JSON")
        .when(F.get_json_object("value", "$.text").isNull(), "no text")
        .when(entities.isNotNull() & ~F.startswith(F.ltrim(entities), F.lit("[")), "entities is not a list")
    )
    return lines.where(~is_blank("value")).select("line", "value", error.alias("error"))


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files below a folder, each as one text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a .jsonl file (rows with a text) or of another file (each line that isn't blank)."""
    lines = spark.read.text(path)
    if path.endswith(".jsonl"):
        return parse_tolerant(lines, "text string", comments=False).where(~is_blank("text"))
    return lines.where(~is_blank("value")).select(F.col("value").alias("text"))


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """(text) of one file: the first record with a text of .jsonl, the text or content of .json, else everything."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))  # numbered in the order of the file
        own = rows.select("n", F.from_json("value", "text string, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
        own = own.where(F.col("r._bad").isNull() & ~is_blank("r.text"))
        return own.agg(F.min_by("r.text", "n").alias("text")).where("text is not null")
    whole = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        return whole.select(F.coalesce(F.get_json_object("value", "$.text"), F.get_json_object("value", "$.content")).alias("text"))
    return whole.select(F.col("value").alias("text"))


def read_evaluations(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Per-item evaluation rows below root, with the model and the scope (all or errors) that the path <root>/<model>/<scope>/ names."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(root)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("model"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("scope"))


def load_settings(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The dictionary and the settings that save_settings wrote."""
    rows = spark.read.schema("name string, value string").json(f"{path}/settings").collect()  # a row for each setting
    return spark.read.parquet(f"{path}/terms"), {r.name: r.value for r in rows}


def only_new(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have no result yet."""
    return rows.join(done.select(keys).distinct(), keys, "left_anti")
