import random

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from spanloom.functions.text import TOKEN, WORD_RUN
from spanloom.operators import dictionary as D
from spanloom.operators.automaton import Automaton, cut_tokens, fold

TEXTS = [
    "Η ΟΔΟΣ και İstanbul CSS", "η οδος, οδοσ ΟΔΌΣ istanbul ISTANBUL ıstanbul i̇stanbul", "Straße STRASSE STRAẞE straße ﬁle", "𝒜𝒷 x 𐐀𐐨 𐐨𐐀 😀😀 a😀b", "C++ c++x xC++ .NET a.NET .net, C# c#2 (C#)", "New York  new york NEW\tYORK new yorker",
    "", None, "css", "été ÉTÉ été Été", "a b c a b a b c d", "Ǆ ǆ ǅ Σ ς σ ΣΣ", "٣٤ 34 ３４ _x_ x_", "word " * 30_000 + "οδος",
]
TERMS = [
    "ΟΔΟΣ", "İstanbul", "css", "οδος", "straße", "STRAẞE", "ﬁle", "𐐀𐐨", "😀", "C++", ".NET", "c#", "new york", "York  new", "été", "ÉTÉ", "a b", "a b c", "b c d", "ǆ", "σ", "", None, "34", "_x_", " css", "a", "b", "css", "ΣΣ",
]


def brute(texts, terms):
    low = lambda toks: fold(pa.array(toks, pa.string())).to_pylist()
    cut, word = regex.compile(TOKEN).findall, regex.compile(WORD_RUN).fullmatch
    out = []
    for d, text in enumerate(texts):
        toks = cut(text or "")
        folded, starts = low(toks), [sum(map(len, toks[:i])) for i in range(len(toks))] if len(toks) < 1000 else None
        for o, term in enumerate(terms):
            own = cut(term or "")
            want = low(own)
            for i in range(len(toks) - len(own) + 1 if own else 0):
                if folded[i] == want[0] and folded[i : i + len(own)] == want:
                    before, after = toks[i - 1] if i else "", toks[i + len(own)] if i + len(own) < len(toks) else ""
                    if (word(own[0]) or not word(before)) and (word(own[-1]) or not word(after)):
                        at = starts[i] if starts else sum(map(len, toks[:i]))
                        surface = "".join(toks[i : i + len(own)])
                        out.append((d, at, at + len(surface), surface, "L", o, len(own)))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_both_ways_find_what_a_plain_scan_finds(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    terms = spark.createDataFrame([(t, "L", i) for i, t in enumerate(TERMS)], "term string, label string, ord int").repartition(3)
    want = brute(TEXTS, TERMS)
    found = {r[3] for r in want}
    assert {"ΟΔΟΣ", "οδος", "İstanbul", "istanbul", "CSS", "STRAẞE", "Straße", "𐐨𐐀", "😀", "C++", ".NET"} <= found and "STRASSE" not in found
    assert rows(D.match_by_scan(docs, terms)) == want
    for slots in (1, 1 << 22):
        assert rows(D.match_by_join(docs, terms, slots=slots)) == want
    assert rows(D.match_terms(docs, terms, limit=3)) == rows(D.match_terms(docs, terms)) == want
    assert D.match_terms(docs, terms.limit(0)).count() == D.match_by_join(docs, terms.limit(0)).count() == D.match_terms(docs.limit(0), terms).count() == 0


def test_random_dictionaries_over_few_tokens():
    rnd = random.Random(1)
    for _ in range(60):
        some = lambda n: "".join(rnd.choice(["a", "A", "b", " ", "Σ", "ς", "+", "-", "b"]) for _ in range(n))
        terms, texts = [some(rnd.randrange(0, 5)) for _ in range(12)], [some(rnd.randrange(0, 30)) for _ in range(6)]
        own = Automaton.build(pa.array(terms, pa.string()), pa.array(["L"] * 12), pa.array(range(12), pa.int32()))
        tok, of, _, start = cut_tokens(texts)
        first, n, row = own.match(tok, of)
        got = sorted((int(of[f]), int(start[f]), int(own.ord[r].as_py()), int(k)) for f, k, r in zip(first, n, row, strict=True))
        assert got == sorted((d, s, o, k) for d, s, _, _, _, o, k in brute(texts, terms))


def test_folding_keeps_length():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(len(c) == 1 for c in fold(pa.array(every, pa.string())).to_pylist())


def test_query_meets_letters_beyond_ascii(spark):
    from spanloom.plans.queries_dictionary import accented_terms

    t = accented_terms(spark, "/root/testdata/sf0.001")
    assert t.count() == 120 and t.where(F.col("term") != F.lower("term")).count() > 30
