"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where tables go if the session names no folder, on one machine.
UNSET = "/tmp/spanloom-scratch"
#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator call, as Parquet below spark.checkpoint.dir.

    A written table cuts the lineage and outlives lost executors. The folder is the
    one that the session names in spark.checkpoint.dir; only where that is unset (tests on
    one machine) a folder is chosen here, and a session on several machines without it is an error. Tables that the returned DataFrame still reads
    stay; those that are used up are removed with drop().
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.conf.get("spark.master", "")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = UNSET
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a DataFrame that reads what was written. The shuffle files behind it are removed, since nothing reads them any more."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Remove tables written by save() that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
