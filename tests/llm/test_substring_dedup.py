import random
from collections import Counter

import pytest
from spanloom.llm import substring_dedup as S
from spanloom.llm.common import Scratch

SIZE = 6


def brute(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab cd ef gh ij kl mn op qr st uv".split()) + str(rnd.randrange(30))
    passage = [[word() for _ in range(rnd.randrange(6, 30))] for _ in range(4)]
    texts = [None, "", "  \n ", "one two", "a b c d e f", "x " * 400, "x y " * 300, "p q r s t u v " * 40]
    for _ in range(120):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(passage)
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    return texts + texts[20:24] + ["Ä ö ü ß é ñ ç " * 3, "ä ö ü ß é ñ"]


@pytest.mark.parametrize("hot", [1000, 2])
def test_against_brute_force(spark, hot):
    texts = corpus(hot)
    rows = [(i % 100 if i % 7 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string").repartition(3)
    got = S.remove_repeats(df, Scratch(spark, "test"), size=SIZE, shard_words=300, hot_segments=hot).collect()
    expected = [(r[0], *b) for r, b in zip(rows, brute(texts, SIZE), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_automaton_counts():
    rnd = random.Random(4)
    for _ in range(50):
        seqs = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 25))] for _ in range(4)]
        times = [rnd.randrange(1, 3) for _ in seqs]
        a = S.Automaton()
        for s, n in zip(seqs, times, strict=True):
            a.add(s, n)
        a.close()
        every = Counter()
        for s, n in zip(seqs, times, strict=True):
            for i in range(len(s) - 3):
                every[tuple(s[i : i + 4])] += n
        for s in seqs:
            assert [(i, every[tuple(s[i : i + 4])]) for i in range(len(s) - 3)] == list(a.occurrences(s, 4))
        other = [rnd.choice("abcd") for _ in range(40)]
        assert {i: n for i, n in a.occurrences(other, 4)} == {i: every[tuple(other[i : i + 4])] for i in range(37) if tuple(other[i : i + 4]) in every}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df, Scratch(spark, "test")).collect() == []
