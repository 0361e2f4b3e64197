import hashlib

import numpy as np
from spanloom.llm import centroids
from spanloom.llm.common import Scratch

DDL = "vec_id long, embedding array<float>, cluster string, q int"


def brute(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), w in zip(kept, who, strict=True) if w == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, w, d in last if w == j) for j in range(len(cs))}
    return sorted(((i is None, i or 0, w, d, per[w], sum(per.values()), hashlib.sha256(",".join(map(str, cs[w])).encode()).hexdigest()) for i, w, d in last))


def run(spark, rows, dim, k, rounds):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], DDL).repartition(3)
    got = centroids.clusters(df, Scratch(spark, "t"), dim=dim, k=k, rounds=rounds)
    return sorted((r.id is None, r.id or 0, *r[1:]) for r in got.collect())


def test_clusters_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=4) / 4 + (i % 3)).round(2).tolist()) for i in range(200)]
    grid = [(300 + i, [a / 64, b / 64, 0.0, 0.0]) for i, (a, b) in enumerate((a, b) for a in (-2, 0, 2) for b in (-2, 0, 2))]  # ties
    odd = [(500, None), (501, []), (502, [1.0, 2.0, 3.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan"), 0.0, 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.0] * 4), (7, [0.5] * 4), (7, [0.5] * 4), (8, [-0.001] * 4)]
    for k, rounds in ((16, 3), (5, 0), (1, 2), (400, 2)):
        assert run(spark, rows + grid + odd, 4, k, rounds) == brute(rows + grid + odd, 4, k, rounds)


def test_empty_and_far(spark):
    assert run(spark, [(1, None)], 4, 3, 2) == []
    far = run(spark, [(1, [3e38, -3e38]), (2, [1.0, 1.0])], 2, 1, 0)
    assert len(far) == 2 and max(r[3] for r in far) == 2 * ((1 << 27) - 64) ** 2 or max(r[3] for r in far) > 2**54


def test_scan_stops_early_and_breaks_ties():
    rnd = np.random.default_rng(5)
    c = rnd.integers(-50, 50, (40, 8))
    c[7], c[21] = c[3], c[3]  # equal centroids
    x = np.concatenate([c[rnd.integers(0, 40, 500)] + rnd.integers(-3, 4, (500, 8)), rnd.integers(-60, 60, (300, 8)), (c[:10] + c[10:20]) // 2])
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    means = centroids.SortMeans(c)
    for last in (np.zeros(len(x), int), d.argmin(1), rnd.integers(0, 40, len(x))):
        who, near, measured = means.assign(x, last)
        assert (who == d.argmin(1)).all() and (near == d.min(1)).all() and measured <= d.size
    assert means.assign(x[:500], d[:500].argmin(1))[2] < 500 * 40 / 4
