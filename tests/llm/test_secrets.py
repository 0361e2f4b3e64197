import re

from spanloom.llm import secrets
from spanloom.llm.trigrams import ANY, trigram_query

DDL = "doc_id long, text string, key string, rules int, found int"
PIECES = ["password = hunter22", "PASSWD:'abc'", "Secret=\"a.b/c+d==\"", "token=token=abcdefgh", "secret=token: abcdefgh", "api_key  :  q1w2e3", "apiKey=zz", "AKIA" + "Z9" * 8, "AKIAAKIA" + "B" * 17, "x" + "0123456789abcdef" * 2, "deadbeef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-" + "1234567890ab", "eyJhbGciOiJI.eyJzdWIiOiIx", "ſecret=abcdefgh", "toKen=abcdefgh", "🙂 token=😀abcdefgh", "", "plain words only"]


def brute(text, rules):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def test_against_a_scan(spark):
    texts = PIECES + [None] + [f"{a}\n{b} {a}" for a in PIECES for b in PIECES[::3]] + ["é " * 20_000 + PIECES[0] + " ab" * 20_000 + PIECES[9]]
    rows = [(i % 50 if i % 9 else None, t, "x", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], DDL).repartition(3)
    want = sorted(repr((r[0], brute(r[1], secrets.BASE + secrets.MORE))) for r in rows + rows[:5])
    for limit in (1_000_000, 0):
        got = secrets.find_secrets(df, max_broadcast=limit).collect()
        assert sorted(repr((r.id, [(s.start, s.kind, s.end) for s in r.found])) for r in got) == want
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_base_patterns_mean_the_same():
    """The length is checked after the match; the two shorter patterns give the matches that pass."""
    for text in PIECES + ["AKIA1 AKIA" + "C" * 16, "AKIAX" * 6, "ab" * 11 + "c", "g".join(["a" * 23, "b" * 24, "c" * 60])]:
        for loose, rule, least in (("AKIA[A-Z0-9]+", secrets.BASE[1], 20), ("[0-9a-f]+", secrets.BASE[2], 24)):
            assert [m.span() for m in re.finditer(loose, text) if len(m[0]) >= least] == [m.span() for m in re.finditer(rule.pattern, text)]


def test_queries_hold_for_every_match():
    for r in secrets.BASE + secrets.MORE:
        q = trigram_query(r.pattern)
        for text in PIECES:
            for m in re.finditer(r.pattern, text):
                low = m[0].lower()
                assert any(all(t in low for t in conj) for conj in q), (r.kind, m[0])
    assert trigram_query("[0-9a-f]{24,}") == ANY and trigram_query("abc|x[yz]w") == {frozenset({"abc"}), frozenset({"xyw"}), frozenset({"xzw"})}
