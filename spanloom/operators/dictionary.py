"""Dictionary matching: token table, n-gram equi-join, greedy selection of spans that don't overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.config import TRAILING_TRIM
from ..functions.labels import ACCEPTED
from .automaton import Automaton, are_words, cut_tokens, fold, joined, per_distinct
from .overlaps import overlap_join
from .scratch import Scratch

#: Dictionaries are broadcast up to this many terms and characters, and joined by shuffle beyond.
MAX_BROADCAST_TERMS, MAX_BROADCAST_CHARS = 200_000, 20_000_000
#: Bits that say with which tokens the terms of a larger dictionary begin; a power of two.
FIRST_SLOTS = 1 << 22


def token_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, tok, start): all tokens of each text with code-point offsets, without a shuffle."""
    return token_rows(docs, key, text)


#: Characters of the texts whose tokens are held at a time, about.
PIECE = 300_000


def dealt_out(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs in four parts for each core, by key. A file is read by as many tasks as it has row groups, so a table of one group would leave all work on its texts to one task."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, key)


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of a column's texts, about so many characters at a time; null is empty."""
    texts = [t or "" for t in column.to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", before: int = 0, after: int = 0, blanks: bool = True, pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """token_table with up to so many tokens before (before1 is the nearest) and after (after1, ..) each token of its text, null beyond its ends.

    Without blanks, white-space tokens are left out and are no neighbours; idx counts them. pick (key and idx of all tokens, as whole numbers) says which are
    given out; the others are still neighbours, but never leave Python. Texts are cut in Arrow batches where they are:
    built-in functions give running offsets only by a shuffle of all tokens, or by sums over arrays that cost ten times as much.
    A null text has no tokens.
    """
    kind = docs.schema[key].dataType
    near = [(f"before{k}", -k) for k in range(1, before + 1)] + [(f"after{k}", k) for k in range(1, after + 1)]
    names = ["key", "idx", "tok", "start", *[n for n, _ in near]]

    def rows(texts: list[str], keys: pa.Array):
        tok, of, idx, start = cut_tokens(texts)
        if not blanks:
            own = np.flatnonzero(~pc.match_substring_regex(tok, r"^[ \t\n\r\f]").to_numpy(zero_copy_only=False))
            tok, of, start, idx = tok.take(pa.array(own)), of[own], start[own], idx[own]
        at = np.arange(len(of))
        if pick:
            at = np.flatnonzero(pick(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)[of], idx))
        cols = []
        for _, k in near:
            there = np.clip(at + k, 0, max(0, len(of) - 1))
            cols.append(tok.take(pa.array(there, mask=(there != at + k) | (of[there] != of[at]))))
        if pick:
            tok, of, idx, start = tok.take(pa.array(at)), of[at], idx[at], start[at]
        return of, [pa.array(idx, pa.int32()), tok, pa.array(start, pa.int32()), *cols]

    def run(batches):
        for batch in batches:
            for i, texts in pieces(batch.column(1)):
                of, cols = rows(texts, batch.column(0).slice(i, len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + i)), *cols], names)

    schema = StructType([StructField("key", kind)]).add("idx", "integer").add("tok", "string").add("start", "integer")
    for n, _ in near:
        schema = schema.add(n, "string")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def small(df: DataFrame, limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """df marked for broadcast if it has no more rows than limit; the planner's own choice otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def match_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """Every place of every term: (key, start, end, term, label, ord, n_tokens), before any selection.

    terms: (term, label, ord); a null or empty term has no place. A term matches where its tokens stand in a row, compared by automaton.fold, and no
    word character touches it: ends that are words are whole tokens already, at other ends the neighbouring token must not be a
    word. term is the surface as it stands in the text. A null text has no places.

    A dictionary of at most limit terms and MAX_BROADCAST_CHARS characters is made an automaton once and sent to the texts, which are read once and not
    shuffled. A larger one is joined with the texts' n-grams. Both fold tokens by the same function.
    """
    listed = terms.select("term", "label", "ord")
    size = listed.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    return match_by_scan(docs, listed, key, text) if size.n <= limit and size.chars <= MAX_BROADCAST_CHARS else match_by_join(docs, listed, key, text)


def match_by_scan(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """match_terms for a dictionary that the driver may hold (see match_terms for the bound): one automaton, broadcast."""
    rows = terms.select(F.col("term").cast("string"), F.col("label").cast("string"), F.col("ord").cast("int")).orderBy("ord", "term", "label").toPandas()
    built = Automaton.build(*[pa.array(rows[c], t, from_pandas=True) for c, t in (("term", pa.string()), ("label", pa.string()), ("ord", pa.int32()))])
    sent = docs.sparkSession.sparkContext.broadcast(built)
    kind = docs.schema[key].dataType
    names = [key, "start", "end", "term", "label", "ord", "n_tokens"]

    def run(batches):
        own = sent.value
        for batch in batches:
            for i, texts in pieces(batch.column(1)):
                tok, of, _, start = cut_tokens(texts)
                first, n, row = own.match(tok, of)
                surface = joined(tok, first, n)
                begin = start[first]
                end = begin + pc.utf8_length(surface).to_numpy(zero_copy_only=False)
                at = pa.array(row)
                cols = [batch.column(0).take(pa.array(of[first] + i)), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), surface, own.label.take(at), own.ord.take(at), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = StructType([StructField(key, kind)]).add("start", "integer").add("end", "integer").add("term", "string").add("label", "string").add("ord", "integer").add("n_tokens", "integer")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def folded_terms(terms: DataFrame) -> DataFrame:
    """(label, ord, n_tokens, first, gram, open, close): terms by their folded tokens; terms without a token are left out."""

    def run(batches):
        for batch in batches:
            tok, of, _, _ = cut_tokens([t or "" for t in batch.column(0).to_pylist()])
            own, first, n = np.unique(of, return_index=True, return_counts=True)
            low, word, at = fold(tok), are_words(tok), pa.array(own)
            cols = [batch.column(1).take(at), batch.column(2).take(at), pa.array(n, pa.int32()), low.take(pa.array(first)), joined(low, first, n), pa.array(~word[first]), pa.array(~word[first + n - 1])]
            yield pa.RecordBatch.from_arrays(cols, ["label", "ord", "n_tokens", "first", "gram", "open", "close"])

    kinds = "label string, ord int, n_tokens int, first string, gram string, open boolean, close boolean"
    return terms.select("term", F.col("label").cast("string"), F.col("ord").cast("int")).mapInArrow(run, kinds)


def match_by_join(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", slots: int = FIRST_SLOTS) -> DataFrame:
    """match_terms by an equi-join of n-grams, for dictionaries of any size; texts stay where they are.

    Only n-grams that begin with a token some term may begin with are made: a bit for each of slots hashes of first tokens is sent
    to the texts, a bound that holds for any dictionary.
    """
    t = Scratch(docs.sparkSession, "terms").save(folded_terms(terms))
    sizes = sorted(r.n_tokens for r in t.select("n_tokens").distinct().collect())  # a row for each length of a term
    used = np.zeros(slots, bool)
    used[[r.s for r in t.select(F.pmod(F.xxhash64("first"), F.lit(slots)).alias("s")).distinct().collect()]] = True  # at most slots rows
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(used))
    kind = docs.schema[key].dataType
    names = ["key", "start", "n", "gram", "surface", "before", "behind"]

    def run(batches):
        bits = np.unpackbits(sent.value).astype(bool)
        begins = lambda token: bits[xxhash.xxh64_intdigest(token.encode(), 42) % slots]
        for batch in batches:
            for i, texts in pieces(batch.column(1)):
                tok, of, _, start = cut_tokens(texts)
                low, last = fold(tok), np.searchsorted(of, of, "right")
                at = np.flatnonzero(per_distinct(low, begins))
                for n in sizes:
                    first = at[at + n <= last[at]]
                    near = [np.clip(first + k, 0, max(0, len(of) - 1)) for k in (-1, n)]
                    word = [are_words(tok.take(pa.array(x))) & (of[x] == of[first]) & (x == first + k) for x, k in zip(near, (-1, n), strict=True)]
                    size = np.full(len(first), n)
                    cols = [batch.column(0).take(pa.array(of[first] + i)), pa.array(start[first], pa.int32()), pa.array(size, pa.int32()), joined(low, first, size), joined(tok, first, size), pa.array(word[0]), pa.array(word[1])]
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = StructType([StructField("key", kind)]).add("start", "integer").add("n", "integer").add("gram", "string").add("surface", "string").add("before", "boolean").add("behind", "boolean")
    grams = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("gram", "_gram")
    hit = grams.join(t, (F.col("_gram") == F.col("gram")) & (F.col("n") == F.col("n_tokens"))).where("not (open and before) and not (close and behind)")
    return hit.select(F.col("key").alias(key), "start", (F.col("start") + F.length("surface")).alias("end"), F.col("surface").alias("term"), "label", "ord", "n_tokens")


def greedy(spans: DataFrame, order: Sequence[Column], key: str = "doc_id") -> DataFrame:
    """Spans taken in the given order per document, each if it overlaps none taken before. Needs start and end.

    Only spans are grouped, and each document's are walked once over its marked characters, so the cost grows with their length.
    """
    fields = [c for c in spans.columns if c != key]
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    grouped = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("_rank"), *fields))).alias("spans"))
    grouped = grouped.select(key, F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), "spans")

    def run(batches):
        for batch in batches:
            keep = []
            for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                taken = bytearray(max(ends, default=0) + 1)
                own = []
                for s, e in zip(starts, ends, strict=True):
                    free = taken.find(1, s, e) < 0
                    if free:
                        taken[s:e] = b"\x01" * (e - s)
                    own.append(free)
                keep.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("spans"), pa.array(keep, pa.list_(pa.bool_()))], [key, "spans", "keep"])

    schema = grouped.schema
    out = grouped.mapInArrow(run, f"{key} {schema[key].dataType.simpleString()}, spans {schema['spans'].dataType.simpleString()}, keep array<boolean>")
    return out.select(key, F.explode(F.filter(F.arrays_zip("spans", "keep"), lambda z: z["keep"])).alias("z")).select(key, *[F.col(f"z.spans.{f}").alias(f) for f in fields])


def find_term_spans(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Terms in the order of the dictionary (longest first), each place once, none overlapping: (key, start, end, term, label)."""
    hits = match_terms(docs, terms, key, text)
    return greedy(hits, [F.col("ord"), F.col("start")], key).select(key, "start", "end", "term", "label")


def dictionary_entities(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", guard: Sequence[str] = TRAILING_TRIM) -> DataFrame:
    """Dictionary predictions: longest in tokens, then earliest; a function word counts only in capitals."""
    hits = greedy(match_terms(docs, terms, key, text), [-F.col("n_tokens"), F.col("start"), F.col("ord")], key)
    hits = hits.where(~(F.lower("term").isin(*guard) & (F.col("term") != F.upper("term"))))
    return hits.select(key, "start", "end", "term", F.col("label").alias("category"), F.lit(1.0).alias("confidence"), F.lit("dictionary").alias("source"), F.lit(ACCEPTED).alias("status"))


def filter_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Longest first, then earliest, none overlapping."""
    return greedy(spans, [F.col("start") - F.col("end"), F.col("start")], key)


def align_spans(toks: DataFrame, spans: DataFrame, key: str = "doc_id", mode: str = "contract") -> DataFrame:
    """Spans moved to token ends: the tokens inside (contract), or else those touched (expand); spans without are dropped.

    toks: token_table. White space tokens don't count.
    """
    t = toks.where(~F.col("tok").rlike(r"^[ \t\n\r\f]+$")).select(key, "start", (F.col("start") + F.length("tok")).alias("end"))
    met = overlap_join(spans, t, key, "inner")
    inside = (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end"))
    keys = [c for c in spans.columns]
    agg = met.groupBy(*keys).agg(F.min(F.when(inside, F.col("r_start"))).alias("s1"), F.max(F.when(inside, F.col("r_end"))).alias("e1"), F.min("r_start").alias("s2"), F.max("r_end").alias("e2"))
    pick = (F.col("s1"), F.col("e1")) if mode == "contract" else (F.coalesce("s1", "s2"), F.coalesce("e1", "e2"))
    rest = [c for c in spans.columns if c not in ("start", "end")]
    return agg.select(*rest, F.col("start").alias("raw_start"), F.col("end").alias("raw_end"), pick[0].alias("start"), pick[1].alias("end")).where("start is not null")


def aligned_records(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans ready to be stored: contracted to tokens, expanded where nothing is inside, and without overlaps."""
    return filter_spans(align_spans(token_table(docs, key, text), spans, key, "expand").drop("raw_start", "raw_end"), key)
