"""Clustering of integer vectors around centroids, exactly, with sort-means."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, quoted

#: Clusters, rounds, units in 1, and the seed in front of an id when the first centroids are drawn.
CLUSTERS, ROUNDS, UNITS, SEED = 16, 3, 64, "1:"
#: Components are held within plus and minus this many units, so that a squared distance of 64 components fits 64 bits.
MOST = 1 << 27
#: Vectors measured at a time.
PIECE = 16_384


def quantised(vectors: DataFrame, dim: int, keep: Sequence[Column], vec_col: str = "embedding", units: int = UNITS) -> DataFrame:
    """The columns in keep and q, floor(units * x) of each component, of the vectors with dim components, all finite. Components beyond MOST units are held there."""
    v = F.col(quoted(vec_col)).cast("array<double>")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # not a number is larger than infinity here
    most = F.lit(MOST / units)
    unit = lambda x: F.floor(F.least(F.greatest(x, -most), most) * float(units)).cast("int")
    return vectors.where(whole).select(*keep, F.transform(v, unit).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: str = SEED, id_col: str = "vec_id") -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id, in that order (fewer, if there are fewer rows); a null id counts as empty.

    Each task sends k rows at most. Rows of one id are taken in the order of their components.
    """
    ident = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    few = rows.select(F.sha2(F.concat(F.lit(seed), ident), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in few], np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to b (a row, or as many rows)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class SortMeans:
    """Nearest centroids by looking at the others in the order of their distance from the centroid a vector was last assigned to."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        between = np.stack([squared(centroids, row) for row in centroids])
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances measured): the nearest centroid of each row, the smaller number among ties.

        A centroid further than twice the distance to the last one is further from the vector than that one, and so are
        all after it in the order; one at exactly twice may tie, so the scan stops strictly beyond. Squares are compared, so
        all is exact in integers.
        """
        best, near = last.astype(np.int64), np.zeros(len(x), np.int64)
        measured = 0
        for a in np.unique(best):
            own = np.flatnonzero(last == a)
            r = squared(x[own], self.c[a])
            far = np.argsort(-r, kind="stable")  # those with the largest distance look furthest
            own, r = own[far], r[far]
            d, who = r.copy(), np.full(len(own), a)
            measured += len(own)
            for j, gap in zip(self.order[a], self.between[a], strict=True):
                if j == a:
                    continue
                live = np.searchsorted(-4 * r, -gap, side="right")  # those with gap <= 4 r
                if not live:
                    break
                new = squared(x[own[:live]], self.c[j])
                measured += live
                closer = (new < d[:live]) | ((new == d[:live]) & (j < who[:live]))
                d[:live][closer], who[:live][closer] = new[closer], j
            best[own], near[own] = who, d
        return best, near, measured


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (.., q, cluster) with cluster moved to the nearest centroid, and distance."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    names = [c for c in rows.columns if c not in ("cluster", "distance")]

    def run(batches):
        means = SortMeans(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE):
                part = batch.slice(i, PIECE)
                who, d, _ = means.assign(matrix(part.column("q")), part.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(who, pa.int32()), pa.array(d)], [*names, "cluster", "distance"])

    schema = StructType([f for f in rows.schema.fields if f.name in names]).add("cluster", "integer").add("distance", "long")
    return rows.select(*names, "cluster").mapInArrow(run, schema)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of each cluster's vectors; an empty cluster keeps its centroid.

    Tasks send a sum for each cluster and component, Spark adds them up in decimals; the driver holds clusters times components numbers.
    """
    k, dim = centroids.shape

    def run(batches):
        for batch in batches:
            who, x = batch.column("cluster").to_numpy(), matrix(batch.column("q"))
            total, n = np.zeros((k, dim), np.int64), np.bincount(who, minlength=k)
            np.add.at(total, who, x)
            cols = [np.repeat(np.arange(k), dim), np.tile(np.arange(dim), k), total.ravel(), np.repeat(n, dim)]
            live = cols[3] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[live].astype(np.int64)) for c in cols], ["cluster", "i", "s", "n"])

    sums = rows.select("cluster", "q").mapInArrow(run, "cluster long, i long, s long, n long")
    sums = sums.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # clusters times components rows
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def clusters(vectors: DataFrame, scratch: Scratch, dim: int = 64, k: int = CLUSTERS, rounds: int = ROUNDS, units: int = UNITS, seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with dim finite components; other rows have no cluster and are left out.

    Repeated rows and ids are clustered as rows of their own. With fewer vectors than k there are fewer clusters; an empty table gives an empty one. Every round reads
    the vectors with their last assignments from the shared folder and writes them with new ones, so a lost executor costs one task. A sum
    beyond 64 bits is null.
    """
    rows = scratch.save(quantised(vectors, dim, [F.col(quoted(id_col)).alias("id")], vec_col, units).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(rows, k, seed, "id")
    if not len(centroids):
        return rows.select("id", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        new = scratch.save(assigned(rows, centroids), "round")
        centroids = moved(new, centroids)
        scratch.drop(rows)
        rows = new
    last = scratch.save(assigned(rows, centroids).select("id", "cluster", "distance"), "last")
    scratch.drop(rows)
    per = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    long = lambda v: v if v < 1 << 63 else None
    total = long(sum(per.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = vectors.sparkSession.createDataFrame([(c, long(s), total, digest[c]) for c, s in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(dim: int = 64, k: int = CLUSTERS, rounds: int = ROUNDS, units: int = UNITS, seed: str = SEED) -> str:
    """DuckDB SQL with the rows of clusters() over the table embeddings."""
    near = lambda t: f"""n{t} AS MATERIALIZED (SELECT vec_id, e, c AS cluster, c{t}.m, d AS distance FROM
      (SELECT v.vec_id, v.e, c{t}.c, c{t}.m, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.e[i] - c{t}.m[i]) * (v.e[i] - c{t}.m[i]))) AS d FROM v, c{t}) c{t}
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""  # noqa: E731
    parts = []
    for t in range(rounds):
        parts.append(near(t))
        parts.append(f"""s{t} AS (SELECT cluster, i, CAST(floor(sum(e[i]) / count(*)) AS BIGINT) AS x FROM n{t}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY cluster, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(z.m, c{t}.m) AS m FROM c{t} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS m FROM s{t} GROUP BY cluster) z ON z.cluster = c{t}.c)""")
    parts.append(near(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({units} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e AS m FROM (SELECT sha256('{seed}' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
{(',' + chr(10)).join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM n{rounds}
"""
