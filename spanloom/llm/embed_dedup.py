"""Embedding near-dedup: E8 lattice cells of random projections, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bloom
from ..operators.components import connected_components
from . import families
from .common import Scratch, mix, quoted

#: Tables, E8 lattices (of eight dimensions each) in a table's key, cells probed beside a vector's own, and the size of a cell.
TABLES, LATTICES, PROBES, SCALE = 6, 2, 8, 2.0
#: A sketch has 128 sign bits. At cosine 0.93 two sketches differ in 15 bits, by 4; at more than this (six deviations) no cosine is computed.
MOST_BITS = 40
#: Vectors of one block of a comparison. Cells of up to SMALL classes are compared pair by pair, larger ones in blocks.
BLOCK, SMALL = 512, 64
#: Buckets of several vectors are broadcast up to this number (16 bytes each); beyond, a filter of them comes first.
MAX_BROADCAST = 1_000_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        whole[k, i], whole[k, j] = a, b
    signs = np.array([[1 - 2 * (m >> k & 1) for k in range(8)] for m in range(256)])
    return np.concatenate([whole, signs[(signs < 0).sum(1) % 2 == 0] / 2])


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
    k = np.abs(d[odd]).argmax(1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 + 1/2, for each row of x (n, 8)."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Projections, cells and sketches for vectors of one dimension."""

    def __init__(self, dim: int, seed: int = 88) -> None:
        rnd = np.random.default_rng([seed, dim])
        self.project = rnd.normal(size=(TABLES, LATTICES, dim, 8)) / SCALE
        self.planes = rnd.normal(size=(dim, 128))

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(vectors, TABLES * (1 + PROBES)) keys: in each table the own cell and the neighbours that lie nearest."""
        out = []
        for t in range(TABLES):
            own, gain = [], []
            for m in self.project[t]:
                x = unit @ m
                cell = nearest_e8(x)
                own.append(cell)
                gain.append(2 - 2 * (x - cell) @ ROOTS.T)  # how much farther the neighbours are, squared
            cell, gain = np.concatenate(own, 1) * 2, np.concatenate(gain, 1)
            near = np.argpartition(gain, PROBES, 1)[:, :PROBES]
            cells = np.repeat(cell[:, None, :], 1 + PROBES, 1).astype(np.int64)
            for p in range(PROBES):
                lattice, root = near[:, p] // len(ROOTS), ROOTS[near[:, p] % len(ROOTS)] * 2
                for k in range(LATTICES):
                    at = np.flatnonzero(lattice == k)
                    cells[at, p + 1, 8 * k : 8 * k + 8] += root[at].astype(np.int64)
            h = np.zeros(cells.shape[:2], np.uint64) + salt[:, None] + np.uint64(t)
            for k in range(cells.shape[2]):
                h = mix(h ^ cells[:, :, k].astype(np.uint64))
            out.append(h)
        return np.concatenate(out, 1).view(np.int64)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1).view("<i8")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision from binary doubles of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lattices(batches, run):
    """Call run(part of a batch, its unit vectors, lattice) for vectors of one dimension, 1024 at a time."""
    made: dict[int, Lattice] = {}
    for batch in batches:
        size = np.array([len(x) for x in batch.column("vector").to_pylist()]) // 8
        for dim in np.unique(size):
            part = batch.filter(pa.array(size == dim))
            for i in range(0, part.num_rows, 1024):
                own = part.slice(i, 1024)
                yield run(own, _matrix(own.column("vector")), made.setdefault(int(dim), Lattice(int(dim))), int(dim))


def _cells(classes: DataFrame) -> DataFrame:
    """(key, cid): a row for each cell of each vector, none twice."""

    def one(own, unit, lattice, dim):
        keys = lattice.keys(unit, mix(own.column("group").to_numpy().astype(np.int64).view(np.uint64) + np.uint64(dim)))
        keys.sort(axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        cid = np.broadcast_to(own.column("cid").to_numpy()[:, None], keys.shape)
        return pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(cid[new])], ["key", "cid"])

    return classes.select("cid", "group", "vector").mapInArrow(lambda batches: _lattices(batches, one), "key bigint, cid bigint")


def _sketches(classes: DataFrame) -> DataFrame:
    """(cid, s1, s2): the sign bits of each vector."""

    def one(own, unit, lattice, dim):
        s = lattice.sketch(unit)
        return pa.RecordBatch.from_arrays([own.column("cid"), pa.array(s[:, 0]), pa.array(s[:, 1])], ["cid", "s1", "s2"])

    return classes.select("cid", "vector").mapInArrow(lambda batches: _lattices(batches, one), "cid bigint, s1 bigint, s2 bigint")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most MOST_BITS bits."""
    side = lambda x: sketches.select(F.col("cid").alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"))
    bits = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(bits <= MOST_BITS).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of one group with cosine >= least, in double precision."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("group").alias(f"g_{x}"), F.col("vector").alias(f"v_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("g_a = g_b and length(v_a) = length(v_b)")

    def run(batches):
        for batch in batches:
            size = np.array([len(x) for x in batch.column("v_a").to_pylist()])
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                cosine = (_matrix(part.column("v_a")) * _matrix(part.column("v_b"))).sum(1)
                yield part.select(["a", "b"]).filter(pa.array(cosine >= least))

    return both.select("a", "b", "v_a", "v_b").mapInArrow(run, "a bigint, b bigint")


def _links_in_families(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of families (columns of families.cells with group and vector), two blocks at a time."""

    def run(table: pa.Table) -> pa.Table:
        cid, comp, group = (table.column(c).to_numpy() for c in ("cid", "comp", "group"))
        left = table.column("left").to_numpy(zero_copy_only=False)
        size = np.array([len(x) for x in table.column("vector").to_pylist()])
        out = [np.zeros((0, 2), np.int64)]
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            unit = _matrix(table.column("vector").take(pa.array(at)))
            x, y = np.flatnonzero(left[at]), np.flatnonzero(~left[at])
            if left.all():  # a block with itself
                y = x
            for k in range(0, len(x), BLOCK):
                i = x[k : k + BLOCK]
                hit = (unit[i] @ unit[y].T >= least) & (comp[at[i]][:, None] != comp[at[y]]) & (group[at[i]][:, None] == group[at[y]])
                p, q = np.nonzero(hit)
                out.append(np.stack([cid[at[i[p]]], cid[at[y[q]]]], 1))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy(*families.KEYS).applyInArrow(run, "a bigint, b bigint")


def _degrees(members: DataFrame, least: float) -> DataFrame:
    """(cid, linked): how many vectors of other classes each class is linked with, all pairs of a component compared in blocks.

    members: (comp, cid, copies, vector). Components of up to BLOCK classes share groups; larger ones are cut into blocks,
    and each pair of blocks is a group of its own.
    """
    size = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    total = size.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]
    rows = members.join(size, "comp").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    rows = rows.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(max(1, total // BLOCK)))).otherwise(F.col("comp")))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("large", F.col("blocks") > 1)
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("b", k).alias("i"), F.greatest("b", k).alias("j")))
    rows = rows.withColumn("cell", F.explode(cell)).select("large", "bin", "cell.i", "cell.j", "b", "comp", "cid", "copies", "vector")

    def run(table: pa.Table) -> pa.Table:
        i, j, b = (table.column(c).to_numpy() for c in ("i", "j", "b"))
        comp, cid, copies = (table.column(c).to_numpy() for c in ("comp", "cid", "copies"))
        size = np.array([len(x) for x in table.column("vector").to_pylist()])
        linked = np.zeros(len(cid), np.int64)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            unit = _matrix(table.column("vector").take(pa.array(at)))
            x, y = np.flatnonzero(b[at] == i[at]), np.flatnonzero(b[at] == j[at])
            for k in range(0, len(x), BLOCK):
                left = x[k : k + BLOCK]
                hit = (unit[left] @ unit[y].T >= least) & (comp[at[left]][:, None] == comp[at[y]]) & (cid[at[left]][:, None] != cid[at[y]])
                linked[at[left]] += (hit * copies[at[y]]).sum(1)
                if i[0] != j[0]:
                    linked[at[y]] += (hit * copies[at[left]][:, None]).sum(0)
        return pa.table({"cid": cid, "linked": linked})

    return rows.groupBy("large", "bin", "i", "j").applyInArrow(run, "cid bigint, linked bigint").groupBy("cid").agg(F.sum("linked").alias("linked"))


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared if their group is equal and not null (of whatever type, compared by a 64-bit hash) and they have one length, and linked at
    cosine >= least in double precision. Equal vectors of a group form a class. Each class stands in the cells of TABLES tables: its projection's nearest
    points of E8 lattices and the PROBES neighbouring points that are nearest. Cells of one class are put aside at once. In the others, classes are paired with the
    smallest one; pairs whose sign sketches are near enough are verified. Classes that are then outside the component of their cell's
    smallest class are paired with the others of the cell, under the same tests; if the cell is large, they are compared with all of its family in
    blocks (see families.cells), so no cell is unfolded into pairs. Within components all pairs are compared,
    in blocks, so n_links counts every link between vectors that were found to hang together; equal vectors count.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without group, link with nothing: n_links is 0 and
    component_id their own id. A null id is never smallest; a component of null ids only has a null component_id. Rows that repeat are
    copies of each other. Other columns are not read; an empty table gives an empty one.
    """
    v = F.col(quoted(vector_col)).cast("array<double>")
    label = F.col(quoted(group_col))
    good = label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(label).alias("group"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumn("cid", F.when(F.col("good"), F.xxhash64("group", "vector"))).withColumn("check", F.when(F.col("good"), F.xxhash64("vector", "group", F.lit(1))))

    def pack(batches):
        for batch in batches:
            raw = [None if not ok else np.array(x).tobytes() for ok, x in zip(batch.column("good").to_pylist(), batch.column("vector").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "group", "cid", "check"]).columns, pa.array(raw, pa.binary())], ["id", "group", "cid", "check", "vector"])

    packed = scratch.save(rows.mapInArrow(pack, "id bigint, group bigint, cid bigint, check bigint, vector binary"), "vectors")
    classes = scratch.save(packed.where("cid is not null").groupBy("cid", "check").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("group").alias("group"), F.first("vector").alias("vector")), "classes")
    cells = scratch.save(_cells(classes), "cells")
    sketches = scratch.save(_sketches(classes), "sketches")
    hubs = scratch.save(cells.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1"), "hubs")
    n = hubs.count()
    if n <= MAX_BROADCAST:
        members = cells.join(F.broadcast(hubs), "key")
    else:
        words = bloom.n_words(n)
        tested = bloom.probe(cells, F.col("key"), scratch.save(bloom.build(hubs, F.col("key"), words), "filter"), words, "_hit", broadcast=words <= bloom.MAX_WORDS)
        members = tested.where("_hit").drop("_hit").join(hubs, "key")
    members = scratch.save(members, "members")
    scratch.drop(cells, hubs)
    star = members.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    links = scratch.save(_verified(_near(star, sketches), classes, least), "links")
    first = scratch.save(connected_components(links, scratch), "components")
    open_ = scratch.save(families.open_buckets(members.where("members > 2"), first).select("key", "members", "family", "cid", "comp"), "families")
    small = open_.where(F.col("members") <= SMALL)
    outside = small.where("comp <> family").select("key", F.col("cid").alias("x"), F.col("comp").alias("comp_x"))
    met = outside.join(small.select("key", F.col("cid").alias("y"), "comp"), "key").where("comp <> comp_x")
    met = _verified(_near(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sketches), classes, least)
    large = open_.where(F.col("members") > SMALL).select("family", "cid", "comp").distinct()
    large = _links_in_families(families.cells(large, classes.select("cid", "group", "vector"), BLOCK), least)
    more = scratch.save(met.unionByName(large), "links")
    scratch.drop(members, sketches, open_)
    last = first if not more.take(1) else scratch.save(connected_components(links.unionByName(more), scratch), "components")
    members = scratch.save(last.withColumnRenamed("node", "cid").join(classes, "cid").select("comp", "cid", "id", "copies", "vector"), "members")
    degrees = _degrees(members.drop("id"), least)
    named = members.select("comp", "cid").join(members.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("cid", "component_id")
    known = classes.select("cid", "check", "copies", "id").join(named, "cid", "left").join(degrees, "cid", "left")
    known = scratch.save(known.select("cid", "check", F.coalesce("component_id", "id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "known")
    out = packed.select("id", "cid", "check").join(known, ["cid", "check"], "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
