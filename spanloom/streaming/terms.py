"""What is known of each term so far, over micro-batches: how often it was found and overruled, by label, forgotten after a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND, OVERRULED = "found", "overruled"
COUNTS = "term string, label string, found long, overruled long, documents long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def happenings(entities: DataFrame, events: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(term, label, doc, start, kind): entities as found, events of the override log as overruled under the label that lost. A null or empty term is left out."""
    part = lambda df, label, kind: df.select(F.lower("term").alias("term"), F.coalesce(F.col(label), F.lit("")).alias("label"), F.col(key).cast("string").alias("doc"), F.col("start").cast("long").alias("start"), F.lit(kind).alias("kind"))
    own = part(entities, "category", FOUND)
    if events is not None:
        own = own.unionByName(part(events, "ml_label", OVERRULED))
    return own.where("term <> ''")


def term_counts(rows: DataFrame) -> DataFrame:
    """The counts over a whole table of happenings; a place that is told twice counts once."""
    once = rows.select("term", "label", "doc", "start", "kind").distinct()
    return once.groupBy("term", "label").agg(F.count_if(F.col("kind") == FOUND).alias("found"), F.count_if(F.col("kind") == OVERRULED).alias("overruled"), F.count_distinct("doc").alias("documents"))


class Counter(StatefulProcessor):
    """State of a key (term, salt), all with the same time to live: the places met, the documents met by label, and the counts by label."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "label string, doc string, start long, kind string", "met boolean", self.ttl_ms)
        self.docs = handle.getMapState("docs", "label string, doc string", "met boolean", self.ttl_ms)
        self.counts = handle.getMapState("counts", "label string", "found long, overruled long, documents long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[str, list[int]] = {}
        for frame in rows:
            for label, doc, start, kind in frame[["label", "doc", "start", "kind"]].drop_duplicates().itertuples(index=False):
                place = (label, doc, int(start), kind)
                if self.places.containsKey(place):
                    continue
                self.places.updateValue(place, (True,))
                n = added.setdefault(label, [0, 0, 0])
                n[kind == OVERRULED] += 1
                if not self.docs.containsKey((label, doc)):
                    self.docs.updateValue((label, doc), (True,))
                    n[2] += 1
        out = []
        for label, n in added.items():
            before = tuple(self.counts.getValue((label,))) if self.counts.containsKey((label,)) else (0, 0, 0)
            now = tuple(int(a + b) for a, b in zip(before, n, strict=True))
            self.counts.updateValue((label,), now)
            out.append((key[0], int(key[1]), label, *now))
        if out:
            yield pd.DataFrame(out, columns=["term", "salt", "label", "found", "overruled", "documents"])

    def close(self) -> None:
        pass


def term_counts_stream(rows: DataFrame, ttl_ms: int, salts: int = 16) -> DataFrame:
    """(term, salt, label, found, overruled, documents) of a stream of happenings: after each micro-batch, the new counts of what it changed.

    A term's documents are spread over salts, so that a frequent term is many keys; latest() adds them up. A place that comes again within the time to
    live counts once, whatever batch it comes in; what is not met for that long is forgotten. Needs a session with the state store of
    PROVIDER (configure()); rows without a document or a start are left out.
    """
    salted = rows.where("doc is not null and start is not null").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    return salted.groupBy("term", "salt").transformWithStateInPandas(Counter(ttl_ms), "term string, salt int, label string, found long, overruled long, documents long", "Update", "ProcessingTime")


def latest(updates: DataFrame) -> DataFrame:
    """COUNTS from the updates (with the number of their batch) of a stream: the last of each salt, added up."""
    last = updates.groupBy("term", "salt", "label").agg(F.max_by(F.struct("found", "overruled", "documents"), "batch").alias("n"))
    return last.groupBy("term", "label").agg(*[F.sum(f"n.{c}").alias(c) for c in ("found", "overruled", "documents")])


def configure(spark: SparkSession) -> None:
    """The state store, and no batches without rows: with a time to live they would follow one another without end, and what has expired is passed over when read anyway."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def count_stream(rows: DataFrame, out: str, checkpoint: str, ttl_ms: int, run: str = "terms"):
    """Start a query that writes the updates of each micro-batch once (sources/batches.py) below out; returns the StreamingQuery."""
    from ..sources.batches import write_batch

    configure(rows.sparkSession)

    def one(batch: DataFrame, number: int) -> None:
        write_batch(batch, out, run, number)

    return term_counts_stream(rows, ttl_ms).writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
