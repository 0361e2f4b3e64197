"""A sink that can be repeated: batches of a run, each written once, however often it is tried."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

MANIFEST = "run string, batch long"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_committed(spark: SparkSession, path: str, run: str, batch: int) -> bool:
    return exists(spark, f"{path}/manifest/run={run}/batch={int(batch)}/_SUCCESS")


def write_batch(rows: DataFrame, path: str, run: str, batch: int) -> bool:
    """Write a batch unless the manifest names it already; says whether it was written.

    The rows go to a folder of their own, which a new attempt overwrites; the manifest gets its entry after them, and readers go by
    the manifest. So a batch that was cut off shows nothing, and one that is repeated shows its rows once, whatever columns or number of rows
    the attempts had. Attempts at the same batch must follow one another (as foreachBatch does); different batches may run side by side.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run is named by letters, digits, _, . and -, not {run!r}")
    taken = {c.lower() for c in rows.columns} & {"run", "batch"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the sink's own")
    spark, place = rows.sparkSession, f"run={run}/batch={int(batch)}"
    if is_committed(spark, path, run, batch):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/data/{place}")
    entry = spark.range(1).select(F.lit(run).alias("run"), F.lit(int(batch)).cast("long").alias("batch"))
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{place}")
    return True


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch) of the batches that are complete."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest").distinct()


def read_batches(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """Rows of complete batches (of the runs named, or all) with their run and batch; columns of later batches are added."""
    found = spark.read.option("mergeSchema", True).parquet(f"{path}/data").schema
    own = StructType([f for f in found.fields if f.name not in ("run", "batch")])
    rows = spark.read.schema(own.add("run", StringType()).add("batch", LongType())).parquet(f"{path}/data")
    done = committed(spark, path)
    if runs is not None:
        done = done.where(F.col("run").isin(*runs))
    return rows.join(done, ["run", "batch"], "left_semi")
