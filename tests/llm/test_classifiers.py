import random

from pyspark.sql import functions as F
from spanloom.llm import quality, toxicity
from spanloom.llm.common import crc_mod

DDL = "doc_id long, text string, n_chars long, score string, y int"


def corpus(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 7)))
    docs, labels = [], []
    for i in range(700):
        w = [word() for _ in range(rnd.randrange(20, 120))]
        junk, toxic = rnd.random() < 0.25, rnd.random() < 0.3
        if junk:
            w = [x.upper() + "!!" for x in w[:8]] * 6
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["vilezot", "grumpok", "nastifer" + word()])
        docs.append((i, " ".join(w), None, "s", 1))
        labels.append((i, int(not junk), int(toxic), "t"))
    docs += [(None, None, None, None, None), (900, "", 0, "", 0), (901, "  \n", 3, "", 0), (902, "!!! ...", None, "", 0), (903, "word " * 30_000, None, "", 0), (904, "same", None, "", 0), (904, "same", None, "", 0)]
    labels += [(None, 1, 1, ""), (800, None, None, ""), (904, 1, 0, ""), (904, 0, 1, "")]
    return spark.createDataFrame(docs, DDL).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def check(scored, labels, column, held, cut):
    rows = scored.collect()
    assert len(rows) == 707 and all(0 <= r.score <= 1 for r in rows)
    y = {r.doc_id: r[column] for r in labels.collect()}
    test = [r for r in rows if r.doc_id is not None and r.doc_id < 700 and r.held]
    right = sum((r.score >= cut) == bool(y[r.doc_id]) for r in test) / len(test)
    assert len(test) > 50 and right >= 0.93, right
    twins = [r.score for r in rows if r.doc_id == 904]
    assert twins[0] == twins[1]


def test_quality_held_out(spark):
    docs, labels = corpus(spark)
    learn = crc_mod("doc_id", 4) != 2
    m = quality.train(docs, labels, learn)
    check(quality.score(docs, m, [F.col("doc_id"), (~learn).alias("held")]), labels, "quality", "held", 0.7)


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    learn = crc_mod("doc_id", 5) != 0
    m = toxicity.train(docs, labels, learn)
    check(toxicity.score(docs, m, [F.col("doc_id"), (~learn).alias("held")]), labels, "toxic", "held", 0.5)


def test_nothing_or_one_class_to_learn_from(spark):
    docs, labels = corpus(spark)
    for some in (labels.limit(0), labels.where("quality = 1 and toxic = 0")):
        a = quality.score(docs, quality.train(docs, some, F.lit(True)), [F.col("doc_id")]).select("score").distinct().collect()
        b = toxicity.score(docs, toxicity.train(docs, some, F.lit(True)), [F.col("doc_id")]).select("score").distinct().collect()
        assert len(a) == len(b) == 1
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels, F.lit(True)), [F.col("doc_id")]).count() == 0


def test_identity_of_the_machine():
    import numpy as np

    rnd = np.random.default_rng(0)
    m = quality.Machine(0.3, rnd.normal(size=quality.FEATURES), rnd.normal(size=(quality.FEATURES, quality.FACTORS)))
    row, feat, value = quality.features([b"some words and some MORE words!!", b""], [3, None])
    y = m.raw(row, feat, value, 2)[0]
    for r in (0, 1):
        f, v = feat[row == r], value[row == r].astype(float)
        slow = 0.3 + (m.w[f] * v).sum() + sum(m.v[f[i]] @ m.v[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert abs(slow - y[r]) < 1e-3


def test_gradients_of_the_network():
    import numpy as np

    net = toxicity.fit(["a b c", "d e f"] * 6, [0, 1] * 6, epochs=0)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + (0.1 if k in ("bias", "fb", "bb") else 0)
    rnd = np.random.default_rng(1)
    e, mask = rnd.normal(size=(5, 3, 2 * toxicity.DIM)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    weight = rnd.normal(size=3)
    g, de, _ = net.gradients(e, mask, lambda y: (float(y @ weight), weight))
    loss = lambda: float(net.forward(e, mask) @ weight)
    for k in ("fx", "bh", "att", "out", "fb"):
        at = np.unravel_index(3, net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        assert abs((up - loss()) / 2e-4 - g[k][at]) < 2e-3, k
        net.p[k][at] = old
    e[1, 0, 2] += 1e-4
    up = loss()
    e[1, 0, 2] -= 2e-4
    assert abs((up - loss()) / 2e-4 - de[1, 0, 2]) < 2e-3


def test_windows_cover_whole_texts():
    x = toxicity.Inputs([" ".join(["w"] * n) for n in (0, 1, 47, 48, 49, 84, 85, 500)])
    doc, first = x.windows()
    for d, n in enumerate((0, 1, 47, 48, 49, 84, 85, 500)):
        own = first[doc == d] - x.bound[d]
        seen = {i for s in own for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(own, own[1:]))
