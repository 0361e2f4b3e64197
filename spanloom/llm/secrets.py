"""Secret scans over a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, key64, quoted, text_of
from .trigrams import ANY, trigram_query

#: Documents that may need a check by an indexed rule are named by broadcast up to this number (16 bytes each), beyond by a shuffled join.
MAX_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping, whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    """A pattern in which each ASCII letter stands for both cases."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


BASE = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # the matches of AKIA[A-Z0-9]+ with 20 characters or more
    Rule("hex", "[0-9a-f]{24,}"),  # the runs of [0-9a-f] with 24 characters or more
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)


def build_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, key) of the vocabulary's trigrams in the lower-cased texts of docs(key, text)."""
    found = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary])  # compiled, unlike a filter over an array
    low = docs.select("key", F.lower("text").alias("low"))
    return low.select("key", F.explode(F.filter(found, lambda t: t.isNotNull())).alias("trigram"))


def candidates(postings: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """(key, rules): the numbers of the rules whose trigram query holds for the document."""
    terms = [(n, c, t, len(conj)) for n, r in rules for c, conj in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for t in sorted(conj)]
    spark = postings.sparkSession
    plan = F.broadcast(spark.createDataFrame(terms, "rule int, conj int, trigram string, need int"))
    met = postings.join(plan, "trigram").groupBy("key", "rule", "conj", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need")
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's matches in a text as structs of code-point offsets, end exclusive.

    Each match is taken with the gap before it, anchored where the last match ended, so lengths add up to offsets.
    """
    pattern = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    parts = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(2 + rule.group)), F.length).alias("counted"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["0"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["1"]).alias("end"))
        return F.struct((start + m["1"]).alias("at"), F.when(m["2"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    parts = F.transform(parts, lambda m: F.struct(m["gap"].alias("0"), m["size"].alias("1"), m["counted"].alias("2")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs' id as id, with found: an array of (start, kind number, end), ordered by start, then kind.

    Each rule's pattern is turned into a Boolean query over mandatory trigrams. The index holds, for the trigrams that any
    query names, the documents that contain them; postings are intersected per conjunction, and only documents for which
    some conjunction is complete are verified with the pattern itself, on the whole text. A rule without mandatory
    trigrams scans every text. A null text is empty. Documents are told apart by a hash of id and text: rows that agree
    in both have one posting list and each gets its result; a clash of hashes only means one needless check. Other columns are
    not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_of(quoted(text_col)).alias("text")).withColumn("key", key64("id", "text"))
    numbered = list(enumerate(rules))
    indexed = [(n, r) for n, r in numbered if trigram_query(r.pattern) != ANY]
    kinds = {r.kind: n for n, r in numbered}
    if indexed:
        scratch = Scratch(docs.sparkSession, "trigrams")
        vocabulary = sorted({t for _, r in indexed for conj in trigram_query(r.pattern) for t in conj})
        postings = scratch.save(build_index(rows, vocabulary), "postings")
        found = scratch.save(candidates(postings, indexed), "candidates")
        scratch.drop(postings)
        side = F.broadcast(found) if found.count() <= max_broadcast else found
        rows = rows.join(side, "key", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for n, r in numbered:
        if any(n == m for m, _ in indexed):
            on = F.coalesce(F.array_contains("rules", n), F.lit(False))
        else:
            on = F.col("text").rlike(r.pattern)
        parts.append(F.when(on, _spans(F.col("text"), r, kinds[r.kind])).otherwise(empty))
    return rows.select("id", F.array_sort(F.concat(*parts)).alias("found"))


def span_text(found: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_sql(rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> str:
    """DuckDB SQL for the digest of every document."""
    quote = lambda p: p.replace("'", "''")
    per_rule = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{quote(r.pattern)}') AS g, regexp_extract_all(t, '{quote(r.pattern)}') AS h, regexp_extract_all(t, '{quote(r.pattern)}', {r.group}) AS v FROM d" for k, r in enumerate(rules)
    )
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE {cond}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({per_rule}),
x AS (SELECT doc_id, k, kind, least, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, k, kind, h, i,
         CAST(list_sum(list_transform(g[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s
  FROM x WHERE length(v[i]) >= least),
e AS (SELECT doc_id, k, kind, s, s + length(h[i]) AS e FROM s),
a AS (SELECT doc_id, {counts}, {joined(f'k < {base}')} AS base, {joined('true')} AS spans FROM e GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
