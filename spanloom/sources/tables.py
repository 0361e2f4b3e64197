"""Readers of the fixed Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder, in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
