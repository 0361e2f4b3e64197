"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import bloom
from .common import Scratch, Words, mix, pieces, quoted, released, text_of

#: Words of the grams that anchors are chosen from.
GRAM = 8
#: Windows of a segment; their marks fit the bits of a positive long.
MOST_WINDOWS = 62
#: Words of a reference shard, about.
SHARD_WORDS = 50_000
#: Anchors with more different segments than this are cut into single windows, so that no shard depends on one anchor.
HOT_SEGMENTS = 1000
#: Up to so many of these anchors are broadcast (4 MB); more are joined by shuffle.
MOST_HOT = 500_000
#: The filter of repeated anchors has 2^20 to 2^28 bits (32 MB), which bounds what is collected and broadcast.
FILTER_BITS = (20, 28)


#: Bytes of the texts that a task holds as arrays at a time, about.
PIECE = 2_000_000


class Automaton:
    """A suffix automaton of several word sequences, with the number of places where each state's sequences end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def _clone(self, p: int, w, q: int) -> int:
        c = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list, times: int) -> None:
        """Add one sequence that occurs so many times."""
        last, nxt, link, length, count = 0, self.next, self.link, self.len, self.count
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # the prefix is known already
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
            else:
                p, last = last, self._new(length[last] + 1, 0, {})
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[last] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            count[last] += times

    def close(self) -> None:
        """Carry the counts to all suffixes."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def occurrences(self, words: list, size: int) -> Iterator[tuple[int, int]]:
        """Stream words: for each place where the match is at least size long, its first word and how often its last size words occur."""
        s, n = 0, 0
        nxt, link, length = self.next, self.link, self.len
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            s, n = (nxt[s][w], n + 1) if w in nxt[s] else (0, 0)
            if n >= size:
                n = size
                while length[link[s]] >= size:
                    s = link[s]
                yield i - size + 1, self.count[s]


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of n values."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Segments:
    """Runs of windows that share their anchor, the least hash of the grams inside a window; every window is in one segment."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        w = self.words = Words(texts)
        self.n = w.last - w.first
        h = w.hashes()
        k = min(GRAM, size)
        self.anchor, self.doc, self.first, self.count, self.times = (np.zeros(0, np.int64) for _ in range(5))
        if len(h) < size:
            return
        grams = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(grams)]
        grams = mix(grams)
        least = _sliding_min(grams, size - k + 1)  # for each window of the whole buffer
        doc = np.repeat(np.arange(len(texts)), self.n)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + size <= w.last[doc])  # windows inside one text
        if not len(at):
            return
        least, doc = least[at], doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at)))
        cuts = -(-length // MOST_WINDOWS)
        run = np.repeat(np.arange(len(start)), cuts)
        part = np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = start[run] + part * MOST_WINDOWS
        self.count = np.minimum(length[run] - part * MOST_WINDOWS, MOST_WINDOWS)
        self.anchor, self.doc = least[begin].view(np.int64), doc[begin]
        self.first = at[begin] - w.first[self.doc]
        span = self.count + size - k  # grams of a segment; those equal to the anchor show whether a window can repeat inside
        edge = np.cumsum(span) - span
        same = grams[np.arange(span.sum()) + np.repeat(at[begin] - edge, span)] == np.repeat(least[begin], span)
        self.times = np.add.reduceat(same, edge, dtype=np.int64)

    def content(self, i: int, size: int) -> bytes:
        """The words of segment i, joined by one space."""
        a = self.first[i] + self.words.first[self.doc[i]]
        return b" ".join(self.words.buf[self.words.start[a] : self.words.end[a + self.count[i] + size - 2]].split())


def _anchor_counts(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, n): how often each anchor occurs in segments, summed for each piece of input."""

    def run(batches):
        for batch in released(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for i, j in pieces(texts, PIECE):
                s = Segments(texts[i:j], size)
                anchor, inverse = np.unique(s.anchor, return_inverse=True)
                n = np.bincount(inverse, s.times, len(anchor)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(n, pa.int64())], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor bigint, n bigint")


def _filter(values: DataFrame) -> tuple[np.ndarray, int]:
    """A bit map of a column of hashes, and the number of its bits as a power of two."""
    n = values.count()
    power = int(np.clip(np.ceil(np.log2(max(1, 16 * n))), *FILTER_BITS))
    slot = F.shiftrightunsigned(F.col(values.columns[0]), 64 - power) + 1  # bucket b holds the numbers (b - 1) * 32768 + 1 .. b * 32768
    parts = values.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    size = 1 << (power - 3)
    out = np.zeros(size, np.uint8)
    for r in parts.toLocalIterator():
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out, power


def _in(values: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    slot = (values.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _segments(docs: DataFrame, size: int, anchors: tuple[np.ndarray, int], needed: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """The segments whose anchor passes the filter: (key, key2, first, windows, inner, anchor, hi, lo); with a second filter, on
    hi and the key of the text chosen to give a segment's words, (anchor, hi, lo, content) of those that pass both."""
    sent = docs.sparkSession.sparkContext.broadcast((anchors, needed))

    def run(batches):
        by_anchor, by_content = sent.value
        for batch in released(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            keys, keys2 = batch.column("key").to_numpy(), batch.column("key2").to_numpy()
            for i, j in pieces(texts, PIECE):
                s = Segments(texts[i:j], size)
                own = np.flatnonzero(_in(s.anchor, *by_anchor))
                for a in range(0, len(own), 20_000):
                    part = own[a : a + 20_000]
                    content = [s.content(k, size) for k in part]
                    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, content)), ">i8").astype(np.int64).reshape(-1, 2)
                    if by_content is None:
                        cols = [keys[i + s.doc[part]], keys2[i + s.doc[part]], s.first[part].astype(np.int32), s.count[part].astype(np.int32), s.times[part] > 1, s.anchor[part], digest[:, 0], digest[:, 1]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["key", "key2", "first", "windows", "inner", "anchor", "hi", "lo"])
                    else:
                        chosen = np.flatnonzero(_in(digest[:, 0] ^ keys[i + s.doc[part]], *by_content))
                        _, once = np.unique(digest[chosen], axis=0, return_index=True)
                        once = chosen[once]
                        cols = [s.anchor[part][once], digest[once, 0], digest[once, 1]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([content[k] for k in once], pa.binary())], ["anchor", "hi", "lo", "content"])

    return docs.select("key", "key2", "text").mapInArrow(run, "anchor bigint, hi bigint, lo bigint, content binary" if needed else "key bigint, key2 bigint, first int, windows int, inner boolean, anchor bigint, hi bigint, lo bigint")


def _marks(counts: pa.Table, contents: pa.Table, size: int) -> pa.Table:
    """The repeated windows of one shard's segments, as bits, from counts (hi, lo, n) and contents (hi, lo, content)."""
    text = dict(zip(zip(contents.column("hi").to_pylist(), contents.column("lo").to_pylist(), strict=True), contents.column("content").to_pylist(), strict=True))
    keys = list(zip(counts.column("hi").to_pylist(), counts.column("lo").to_pylist(), strict=True))
    words = [text[k].split(b" ") for k in keys]
    automaton = Automaton()
    for w, times in zip(words, counts.column("n").to_pylist(), strict=True):
        automaton.add(w, times)
    automaton.close()
    marks = [sum(1 << first for first, times in automaton.occurrences(w, size) if times > 1) for w in words]
    return pa.table({"hi": counts.column("hi"), "lo": counts.column("lo"), "marks": pa.array(marks, pa.int64())})


def _single_windows(segments: DataFrame, size: int) -> DataFrame:
    """(hi, lo, at, n, whi, wlo): each window of the segments, known by 128 bits of its words' hash."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for hi, lo, n, content in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "n", "content")), strict=True):
                w = content.split(b" ")
                for at in range(len(w) - size + 1):
                    for col, v in zip(rows, (hi, lo, at, n, xxhash.xxh3_128_digest(b" ".join(w[at : at + size]))), strict=True):
                        col.append(v)
            digest = np.frombuffer(b"".join(rows[4]), ">i8").astype(np.int64).reshape(-1, 2)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types, strict=False)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["hi", "lo", "at", "n", "whi", "wlo"])

    return segments.mapInArrow(run, "hi bigint, lo bigint, at int, n bigint, whi bigint, wlo bigint")


def _covered(n: int, firsts, marks, size: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    for first, m in zip(firsts, marks, strict=True):
        at = first + np.flatnonzero(np.unpackbits(np.array([m], "<i8").view(np.uint8), bitorder="little"))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, scratch: Scratch, size: int = 35, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words left of every row's text after all repeated passages are taken out.

    A word goes if some window of size consecutive words that covers it occurs twice or more in the corpus, in one text or in
    several. kept holds the other words, joined by one space.

    Windows are routed by anchor, the least hash of the grams in them, so equal windows have equal anchors. Neighbouring
    windows with one anchor are a segment, and every window is in one segment. A first scan counts anchors; a second
    gives hashes of only the segments whose anchor repeats (a filter of bounded size lets some others pass); a third the
    words of those whose anchor has several segments, or copies of one, from one text that holds them. Different segments,
    with the number of their copies, are the reference; shards of it are cut by anchor, each shard's suffix automaton is built
    where it is used, and the shard's segments are streamed through it for matching statistics: a match of size words that
    ends in a state with two or more places marks its window. Anchors with very many different segments are
    cut into single windows, each its own anchor, counted before the shuffle. Marks go back to the texts by segment.

    A null text is empty. Texts with fewer words than size lose none; an empty table gives an empty one. Ids may be null or repeat: rows are known by
    two hashes of id and text; rows that agree in both are copies of each other. Other columns are not read. Texts are read whole; only those
    that a filter of the marked ones does not rule out are shuffled, to meet their marks.
    """
    docs = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(quoted(text_col)).alias("text")).withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", "doc_id", F.lit(1))})
    anchors = _anchor_counts(docs, size).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    anchors = scratch.save(anchors, "anchors")
    by_anchor = _filter(anchors)
    scratch.drop(anchors)
    found = scratch.save(_segments(docs, size, by_anchor), "segments")
    different = found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.first("anchor").alias("anchor"), F.first("windows").alias("windows"), F.first("inner").alias("inner"), F.min("key").alias("owner"))
    different = scratch.save(different, "different")
    per_anchor = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("windows") + size).alias("words"), F.bool_or("inner").alias("inside"), F.max("n").alias("copies"))
    per_anchor = scratch.save(per_anchor.where("segments > 1 or inside or copies > 1"), "per_anchor")
    is_hot = F.col("segments") > hot_segments
    words, n_hot = per_anchor.agg(F.coalesce(F.sum(F.when(~is_hot, F.col("words"))), F.lit(0)), F.count_if(is_hot)).first()
    hot = per_anchor.where(is_hot).select("anchor")
    hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, words // shard_words))).alias("shard")
    needed = scratch.save(different.join(per_anchor.select("anchor"), "anchor").select("hi", "lo", "n", "anchor", F.col("hi").bitwiseXOR(F.col("owner")).alias("place")), "needed")
    contents = scratch.save(_segments(docs, size, by_anchor, _filter(needed.select("place"))), "contents")
    counts = needed.join(hot, "anchor", "left_anti").select(shard, "hi", "lo", "n")
    texts = contents.join(hot, "anchor", "left_anti").select(shard, "hi", "lo", "content")
    marked = counts.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(lambda a, b: _marks(a, b, size), "hi bigint, lo bigint, marks bigint")
    cut = contents.join(hot, "anchor", "left_semi").select("hi", "lo", "content").join(needed.select("hi", "lo", "n"), ["hi", "lo"]).dropDuplicates(["hi", "lo"])
    windows = scratch.save(_single_windows(cut, size), "windows")
    again = scratch.save(windows.groupBy("whi", "wlo").agg(F.sum("n").alias("times")).where("times > 1").select("whi", "wlo"), "again")
    cut = windows.join(again, ["whi", "wlo"]).groupBy("hi", "lo").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("marks"))
    marks = marked.unionByName(cut).groupBy("hi", "lo").agg(F.bit_or("marks").alias("marks")).where("marks <> 0")
    marks = scratch.save(marks, "marks")
    scratch.drop(windows, again, per_anchor, different, needed, contents)
    places = found.select("key", "key2", "first", "hi", "lo").join(marks, ["hi", "lo"]).groupBy("key", "key2").agg(F.collect_set(F.struct("first", "marks")).alias("places"))
    places = scratch.save(places.select("key", "key2", F.col("places.first").alias("firsts"), F.col("places.marks").alias("marks")), "places")
    scratch.drop(found, marks)

    def clean(batches):
        for batch in released(batches):
            out: list[list] = [[], [], []]
            for text, firsts, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "marks")), strict=True):
                words = text.encode().split()
                gone = 0
                kept = words
                if firsts:
                    cover = _covered(len(words), firsts, marks, size)
                    gone = int(cover.sum())
                    kept = [words[k] for k in np.flatnonzero(~cover)]
                for col, v in zip(out, (len(words), gone, b" ".join(kept).decode()), strict=True):
                    col.append(v)
            cols = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])

    # Texts without marks stay where they are: a Bloom filter of the marked ones tells them from those that have to meet their marks.
    n_words = min(bloom.n_words(places.count()), bloom.MAX_WORDS)
    filled = scratch.save(bloom.build(places, F.col("key"), n_words), "filter")
    tested = bloom.probe(docs, F.col("key"), filled, n_words, "hit")
    met = tested.where("hit").join(places, ["key", "key2"], "left").select("doc_id", "text", "firsts", "marks")
    kinds = {f.name: f.dataType for f in places.schema.fields}
    free = tested.where("not hit").select("doc_id", "text", F.lit(None).cast(kinds["firsts"]).alias("firsts"), F.lit(None).cast(kinds["marks"]).alias("marks"))
    schema = StructType([docs.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return free.unionByName(met).mapInArrow(clean, schema)
