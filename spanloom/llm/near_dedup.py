"""MinHash near-dedup with SetSketch registers: banding, joint estimation, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bloom
from ..operators.components import connected_components
from . import families, setsketch
from .common import Scratch, pieces, quoted, released, text_of
from .setsketch import Shingles

#: Pairs whose estimate is this far below the threshold are not verified (six standard errors of 128 registers).
MARGIN = 0.2
#: Texts needed again are named by broadcast up to so many sets (8 bytes each), and by a shuffled join beyond.
MAX_BROADCAST = 1_000_000


def linked(n_both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union."""
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, n, cid, check, registers): each text's set, known by 128 bits of its hash."""

    def run(batches):
        for batch in released(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.select(["doc_id", "th"])
            for i, j in pieces(texts, 1_000_000):
                s = Shingles(texts[i:j], size)
                some = s.n > 0
                key, regs = s.set_hashes(), iter(s.registers())
                rows = [next(regs).tobytes() if x else None for x in some]
                cols = [*ids.slice(i, j - i).columns, pa.array(s.n, pa.int64()), pa.array(key[:, 0], mask=~some), pa.array(key[:, 1], mask=~some), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "cid", "check", "registers"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, n bigint, cid bigint, check bigint, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)


def _banded(classes: DataFrame) -> DataFrame:
    """(key, cid): a row for each band of each set."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = setsketch.bands(_registers(batch.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("cid").to_numpy(), keys.shape[1]))], ["key", "cid"])

    return classes.select("cid", "registers").mapInArrow(run, "key bigint, cid bigint")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose likelihood estimate isn't far below it."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                j = setsketch.estimate(_registers(part.column("r_a")), _registers(part.column("r_b")), part.column("n_a").to_numpy(), part.column("n_b").to_numpy())
                yield part.select(["a", "b"]).filter(pa.array(j >= percent / 100 - MARGIN))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(cid, hashes): the full sets that are needed, made again from the text of each class's document."""
    named = needed.join(classes.select("cid", "check", "doc"), "cid")
    named = F.broadcast(named) if needed.count() <= MAX_BROADCAST else named
    texts = docs.join(named.select(F.col("doc").alias("_doc"), "cid", "check"), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("cid", "check", "text")

    def run(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            cid, check = batch.column("cid").to_numpy(), batch.column("check").to_numpy()
            for i, j in pieces(texts, 1_000_000):
                s = Shingles(texts[i:j], size)
                key = s.set_hashes()
                own = np.flatnonzero((key[:, 0] == cid[i:j]) & (key[:, 1] == check[i:j]))  # an id may stand on several texts
                rows = [s.hash[s.bound[k] : s.bound[k + 1]].tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(cid[i:j][own], pa.int64()), pa.array(rows, pa.binary())], ["cid", "hashes"])

    return texts.mapInArrow(run, "cid bigint, hashes binary").dropDuplicates(["cid"])


def _counts(rows: list[np.ndarray], cols: list[np.ndarray], limit: int = 40_000_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, intersection sizes) of blocks of all pairs of sorted sets."""
    i = 0
    while i < len(cols):
        j, total = i, 0
        while j < len(cols) and (j == i or (total + len(cols[j])) * (j + 1 - i) <= limit):
            total += len(cols[j])
            j += 1
        flat = np.concatenate(cols[i:j])
        vocabulary, code = np.unique(flat, return_inverse=True)
        holds = np.zeros((len(vocabulary), j - i), np.uint8)
        holds[code, np.repeat(np.arange(j - i), [len(c) for c in cols[i:j]])] = 1
        for k, r in enumerate(rows):
            at = np.searchsorted(vocabulary, r)
            at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == r]
            yield k, i, holds[at].sum(0, dtype=np.int64)
        i = j


def _verify(table: pa.Table, percent: int) -> pa.Table:
    """Links of one group: rows of the left side against rows of the right side, and left against left where the group says so."""
    cid, comp, left = table.column("cid").to_numpy(), table.column("comp").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
    n = np.array([len(s) for s in sets])
    lo, hi = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(hi):  # one block against itself
        hi = lo
    out: list[tuple[int, int]] = []
    for k, first, both in _counts([sets[i] for i in lo], [sets[i] for i in hi]):
        a, b = lo[k], hi[first : first + len(both)]
        found = b[linked(both, n[a], n[b], percent) & (comp[b] != comp[a])]
        out.extend((int(cid[a]), int(cid[x])) for x in found)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _links(grouped: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Verify groups of rows (keys, cid, comp, left, hashes)."""
    return grouped.groupBy(*keys).applyInArrow(lambda t: _verify(t, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th) for every row of docs; th is a hash of the text.

    A document's set holds the distinct shingles of size words of the whole text (fewer words make one shingle, no
    words an empty set, linked with nothing). Documents are linked if 100 * intersection >= percent * union.

    1. Documents with one and the same set form a class; only classes go on, so copies cost nothing.
    2. Bands of SetSketch registers name buckets. In each bucket every class is paired with the smallest only (a star),
       pairs are pruned by size and by the likelihood estimate, and verified on their full sets, hub by hub.
    3. Classes of a bucket that are still in different components after that are compared with one another: they join the
       family of their hub's component, and what is outside the component is verified against all members, in blocks.
       So any two different texts that share a bucket end in one component, or were compared, or are joined through others.
    4. Components of all links; component_id is the smallest id among the documents of their classes.

    Two sets at the threshold share no band with a chance of (1 - 0.8^4)^32, 5 in 10^8.
    Empty input gives empty output. Very long texts are read whole. Nulls: a null text is empty. A null id is never smallest; a component of null ids only has a null component_id and its rows are
    kept. Ids that repeat are allowed: rows go by their own text. kept is whether doc_id equals component_id.
    """
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(quoted(text_col)).alias("text")).withColumn("th", F.xxhash64("text"))
    sketched = scratch.save(_sketches(docs, size), "sketches")
    classes = scratch.save(sketched.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.first("check").alias("check"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    banded = scratch.save(_banded(classes), "bands")
    hubs = scratch.save(banded.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1"), "hubs")
    members = scratch.save(banded.join(hubs, "key"), "members")
    scratch.drop(banded)
    star = scratch.save(_likely(members.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), classes, percent), "star")
    needed = members.where("members > 2").select("cid").unionByName(star.select(F.col("a").alias("cid"))).unionByName(star.select(F.col("b").alias("cid"))).distinct()
    sets = scratch.save(_sets_of(docs, classes, needed, size), "sets")
    many = star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / families.BLOCK).alias("parts"))
    spokes = star.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("cid"), F.lit(False).alias("left"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("cid"), F.lit(True).alias("left"))
    links = scratch.save(_links(spokes.unionByName(heads).join(sets, "cid").withColumn("comp", F.col("cid")), ["a", "part"], percent), "links")
    first = scratch.save(connected_components(links, scratch), "components")
    open_ = scratch.save(families.open_buckets(members.where("members > 2"), first).select("family", "cid", "comp").distinct(), "families")
    more = scratch.save(_links(families.cells(open_, sets, families.BLOCK), families.KEYS, percent), "links")
    scratch.drop(members, hubs, open_, sets, star)
    last = first if not more.take(1) else scratch.save(connected_components(links.unionByName(more), scratch), "components")
    home = classes.select("cid", "doc").join(last.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = home.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = scratch.save(home.join(least, "comp").select("cid", "component_id"), "named")
    out = sketched.select("doc_id", "th", "n", "cid").join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th")


def keep_first(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns, whatever their names.

    Rows that go are named by id and text, so rows that agree in both stay or go together. A row with a null id goes if it is
    linked with a row that has one. Texts stay where they are, but for those that a filter of more than MAX_BROADCAST
    lost rows can't tell from the lost ones.
    """
    lost = near_duplicates(docs, scratch, size, percent, id_col, text_col).where("not kept").select("doc_id", "th").distinct()
    own = [F.col(quoted(id_col)).cast("long"), F.xxhash64(text_of(quoted(text_col)))]
    return bloom.without(docs, own, scratch.save(lost, "lost"), MAX_BROADCAST, scratch)
