"""Exact, near and embedding dedup against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import embed_dedup, exact_dedup, families, near_dedup, setsketch
from spanloom.llm.common import Scratch, Words

DDL = "doc_id long, text string, sha string, kept int, id long, n long"


def rows():
    rnd = random.Random(1)
    texts = [None, "", "a", "a ", "Ä", "long " * 40_000] + [f"text {rnd.randrange(40)}" for _ in range(300)]
    out = [(i if i % 11 else None, t, "x", 1, 5, 6) for i, t in enumerate(texts)]
    return out + out[7:9] + [(1000 + i, "copy", "", 0, 0, 0) for i in range(1500)]


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_exact_groups(spark, words):
    data = rows()
    df = spark.createDataFrame(data, DDL).repartition(5)
    got = exact_dedup.duplicate_groups(df, Scratch(spark, "t"), max_words=words).collect()
    groups = {}
    for r in data:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    want = sorted(repr((r[0], best[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in data)
    assert sorted(repr((r.id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)


def test_exact_rows_that_stay(spark):
    data = rows()
    df = spark.createDataFrame(data, DDL).repartition(5)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len({r[1] or "" for r in data}) == len({r.text or "" for r in got})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(items, linked):
    parent = dict.fromkeys(range(len(items)), 0)
    parent = {i: i for i in parent}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def near_corpus(size):
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    texts = [None, "", "one", "ONE", "One ", "one two", "ONE  two", "İ ß", "w " * 20_000]
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(8, 80))]
        for _ in range(rnd.randrange(1, 14)):
            w = base[:]
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rnd.random() < 0.2 else "\t".join(w))
    chain = [word() for _ in range(60)]
    for i in range(20):
        chain[(3 * i) % 60] = word()
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(spark, size):
    texts = near_corpus(size)
    data = [(i * 3 if i % 13 else None, t, "x", 1, 2, 3) for i, t in enumerate(texts)] + [(6, texts[20], "", 0, 0, 0), (6, texts[20], "", 0, 0, 0)]
    df = spark.createDataFrame(data, DDL).repartition(4)
    sets = [shingles(r[1], size) for r in data]
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    roots = brute_components(sets, link)
    least = {}
    for r, root in zip(data, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted(repr((r[0], len(s), (c := r[0] if not s else least.get(root)), r[0] == c)) for r, s, root in zip(data, sets, roots, strict=True))
    got = near_dedup.near_duplicates(df, Scratch(spark, "t"), size=size).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == want
    stay = near_dedup.keep_first(df, Scratch(spark, "t"), size=size)
    assert stay.columns == df.columns and stay.where("doc_id is not null").count() >= len({c for c in least.values()}) - 1


def test_near_empty_and_blocks(spark, monkeypatch):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DDL), Scratch(spark, "t")).collect() == []
    monkeypatch.setattr(families, "BLOCK", 3)
    test_near_components(spark, 2)


def test_sketch_estimate_and_merge():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 1 << 32, (2, 128), dtype=np.uint64).astype(np.uint32)
    assert (np.maximum(setsketch.spaced(a), setsketch.spaced(b)) == setsketch.spaced(np.minimum(a, b))).all()
    words = [f"w{i}" for i in range(1400)]
    for shared in (200, 600, 1000):
        s = setsketch.Shingles([" ".join(words[:1200]).encode(), " ".join(words[1200 - shared :]).encode()], 1)
        regs = s.registers()
        j = setsketch.estimate(regs[:1], regs[1:], s.n[:1], s.n[1:])[0]
        assert abs(j - shared / 1400) < 0.13


def test_words_are_split_and_hashed_by_content():
    t = ["a b\x0bc\x1cd  ü x", "", "a", "q" * 100 + " " + "q" * 99].__iter__()
    texts = [x.encode() for x in t]
    w = Words(texts)
    got = [w.buf[a:b] for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in t.split()] and list(w.last - w.first) == [len(t.split()) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(got)) and h[0] == h[list(got).index(b"a", 1)]


VEC = "vec_id long, embedding array<float>, label int, cid string, comp int"


def vectors():
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(30, 16))
    out = []
    for i in range(260):
        v = base[i % 30] + rnd.normal(size=16) * rnd.choice([0.0, 0.1, 0.3])
        out.append([float(np.float32(x)) for x in v])
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, out[0][:8], [2 * x for x in out[0]], out[0], out[0]]
    vs = out + odd
    return [(i if i % 17 else None, v, None if i % 19 == 0 else i % 2, "x", 1) for i, v in enumerate(vs)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 4)
    data = vectors()

    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    items = [(unit(v), g) for _, v, g, _, _ in data]
    link = lambda a, b: a[0] is not None and b[0] is not None and a[1] is not None and a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] >= 0.93
    roots = brute_components(items, link)
    degree = [sum(bool(link(a, b)) for j, b in enumerate(items) if j != i) for i, a in enumerate(items)]
    least = {}
    for r, root in zip(data, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted(repr((r[0], int(n), least.get(root), r[0] == least.get(root))) for r, n, root in zip(data, degree, roots, strict=True))
    df = spark.createDataFrame(data, VEC).repartition(3)
    got = embed_dedup.near_vectors(df, Scratch(spark, "t")).collect()
    found = sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got)
    assert len(got) == len(data) and sum(r.n_links for r in got) >= 0.97 * sum(degree)
    assert len(set(found) & set(want)) >= 0.95 * len(set(want))
    assert embed_dedup.near_vectors(df.limit(0), Scratch(spark, "t")).count() == 0


def test_lattice_points_are_nearest():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(200, 8)) * 2
    p = embed_dedup.nearest_e8(x)
    assert len(embed_dedup.ROOTS) == 240 and (np.abs(p.sum(1) % 2) < 1e-9).all()
    d = ((x - p) ** 2).sum(1)
    assert (d[:, None] <= ((x[:, None] - (p[:, None] + embed_dedup.ROOTS)) ** 2).sum(2) + 1e-9).all()


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.935 * x + (1 - 0.935**2) ** 0.5 * z
    lattice, salt = embed_dedup.Lattice(64), np.zeros(600, np.uint64)
    a, b = lattice.keys(x, salt), lattice.keys(y, salt)
    met = np.array([len(set(p) & set(q)) > 0 for p, q in zip(a, b)])
    near = np.array([bin(int(p[0]) ^ int(q[0])).count("1") for p, q in zip(lattice.sketch(x).view(np.uint64), lattice.sketch(y).view(np.uint64))])
    assert met.mean() >= 0.99 and (near <= embed_dedup.MOST_BITS).all()


def test_column_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3)], DDL).withColumn("_near_id", F.lit(1))
    assert exact_dedup.exact_dedup(df).columns == df.columns
