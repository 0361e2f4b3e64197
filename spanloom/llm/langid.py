"""Language identification: script ranges, per-word scores, Viterbi spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Beside, pieces, quoted, released, text_of

#: Training documents of each language, about; a larger language is thinned by a hash of id and text.
TRAIN_DOCS = 2000
#: Letters, and letters times languages, that are scored at a time, about; and characters times languages whose words are labelled side by side.
LETTERS, SCORES, SIDE_BY_SIDE = 300_000, 2_000_000, 8_000_000
#: Buckets of each order of n-grams.
BITS = 16
ORDERS = 3
#: Cost of changing the language between two words, in nats.
SWITCH = 8.0
#: A word's score counts its overlapping n-grams by this part.
TEMPER = 0.4
#: A script is a language's own if it has this share of the language's letters.
SCRIPT_SHARE = 0.01

# First and last code points of scripts.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Latin additional", 0x1E00, 0x1EFF),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x4E00, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
)
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its script's number (the last: none of those listed)."""
    if not _tables:
        n = 0x110000
        script = np.full(n, len(SCRIPTS), np.uint8)
        for k, (_, a, b) in enumerate(SCRIPTS):
            script[a : b + 1] = k
        script[0x1E00:0x1F00] = 0
        _tables.extend([np.fromiter(map(str.isalpha, map(chr, range(n))), bool, n), script])
    return _tables[0], _tables[1]


class Letters:
    """Letters of several texts in a row: code points (0 between words), n-gram buckets, words and each text's words."""

    def __init__(self, texts: list[str]) -> None:
        is_letter, script = _letters()
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low = np.frombuffer("".join(map(_lower, joined)).encode("utf-32-le"), np.uint32) if not joined.isascii() and len(joined.lower()) != len(joined) else np.frombuffer(joined.lower().encode("utf-32-le"), np.uint32)
        letter = is_letter[raw]
        self.at = np.flatnonzero(letter)
        c = np.where(letter, low, 0).astype(np.uint64)
        c = np.concatenate([[0, 0], c, [0, 0]]).astype(np.uint64)
        i = self.at + 2
        two = (c[i] << np.uint64(21)) | c[i + 1]
        three = (two << np.uint64(21)) | c[i - 1]
        four = three ^ (c[i + 2] * np.uint64(0x9E3779B97F4A7C15))
        self.buckets = [((g + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93) ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS) for k, g in enumerate((two, three, four))]
        first = letter & ~np.concatenate([[False], letter[:-1]])
        self.start = np.flatnonzero(first)
        self.script = script[raw[self.start]]
        self.word_at = np.flatnonzero(first[self.at])  # index, among letters, of each word's first
        self.size = np.diff(np.concatenate([self.word_at, [len(self.at)]]))
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(length)])
        self.bound = np.searchsorted(self.start, self.base)


def _lower(c: str) -> str:
    x = c.lower()
    return x if len(x) == 1 else c


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (orders, buckets, languages): log probabilities
    scripts: np.ndarray  # (scripts, languages): whether a word of the script may be of the language

    def words(self, x: Letters) -> np.ndarray:
        """Scores (words, languages), for some words at a time."""
        out = np.zeros((len(x.start), len(self.langs)), np.float32)
        edge = np.append(x.word_at, len(x.at))
        a = 0
        while a < len(x.start):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + SCORES // max(1, len(self.langs)), "right")) - 1)
            s = sum(self.table[k][g[edge[a] : edge[b]]] for k, g in enumerate(x.buckets))
            s = np.add.reduceat(s, edge[a:b] - edge[a], axis=0) * np.float32(TEMPER)
            out[a:b] = np.where(self.scripts[x.script[a:b]], s, s.min(1, keepdims=True) - np.float32(1000))
            a = b
        return out


def viterbi(e: np.ndarray, bound: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word under a constant cost of switching, for all texts side by side; any number of labels."""
    n = np.diff(bound)
    order = np.argsort(-n, kind="stable")
    start, n = bound[:-1][order], n[order]
    label = np.zeros(len(e), np.int32)
    if not len(e):
        return label
    live = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t words
    stays = np.zeros(e.shape, bool)  # whether the best way to a label came from the same label,
    best = np.zeros(len(e), np.int32)  # or else from this one
    v = e[start[: live[0]]]
    for t in range(1, n[0]):
        k = live[t]
        v = v[:k]
        at = start[:k] + t
        top = v.argmax(1)
        least = v[np.arange(k), top][:, None] - np.float32(switch)
        stays[at], best[at] = v >= least, top
        v = np.maximum(v, least) + e[at]
        if t + 1 < n[0] and live[t + 1] < k:
            label[at[live[t + 1] :]] = v[live[t + 1] :].argmax(1)
    last = live[n[0] - 1]
    label[start[:last] + n[0] - 1] = v[:last].argmax(1)
    if n[0] > 1 and live[1] < live[0]:
        one = start[live[1] : live[0]]
        label[one] = e[one].argmax(1)
    for t in range(n[0] - 1, 0, -1):
        at = start[: live[t]] + t
        own = label[at]
        label[at - 1] = np.where(stays[at, own], own, best[at])
    return label


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", per_lang: int = TRAIN_DOCS, id_col: str = "doc_id") -> Model:
    """Counts n-grams of the rows that learn marks: about per_lang documents of each language, by a hash of id and text, and at least
    one. Rows that agree in both are taken or left together. Counting is distributed; what comes to the driver is a count for each language and bucket."""
    rows = docs.where(learn & F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    rows = rows.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"), F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col))).alias("h"))
    sizes = {r.lang: (r.n, r.h) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((ORDERS, 1 << BITS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    of = lambda value: F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, value(*v))])[F.col("lang")]
    sample = rows.where((F.pmod("h", F.lit(1 << 20)) < of(lambda n, h: min(1.0, per_lang / n)) * (1 << 20)) | (F.col("h") == of(lambda n, h: h))).drop("h")

    def count(batches):
        for batch in released(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for a, t in zip(langs, texts, strict=True) if a == lang]
                total = np.zeros((ORDERS << BITS) + len(SCRIPTS) + 1, np.int64)
                for i, j in pieces(own, LETTERS):
                    x = Letters(own[i:j])
                    for k, b in enumerate(x.buckets):
                        total[k << BITS : (k + 1) << BITS] += np.bincount(b.astype(np.int64), minlength=1 << BITS)
                    total[ORDERS << BITS :] += np.bincount(x.script, minlength=len(SCRIPTS) + 1)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    total = np.zeros(((ORDERS << BITS) + len(SCRIPTS) + 1, len(langs)))
    total[counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"])] = counts["n"]
    grams, scripts = total[: ORDERS << BITS].reshape(ORDERS, 1 << BITS, -1), total[ORDERS << BITS :]
    p = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS) / 16)
    own = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0))
    own[~own.any(1)] = True
    return Model(langs, np.log(p).astype(np.float32), own)


def identify(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns in keep, lang_pred, score and spans: array of (start, end, lang) over the letters of mixed texts.

    Letters are grouped in words. A word's script leaves the languages that use it; hashed letter n-grams score
    these; Viterbi with a cost for each switch labels all words of the whole text. lang_pred has the most letters (a tie goes to
    the first by name), and score is its share of the letters. Texts that are null or without letters get `und`,
    score 0 and no spans, and so does every text if there was nothing to learn from. Other columns are not read; an empty table gives an empty
    one. Rows are labelled one by one, so ties and repeated rows need no rule. Memory grows with the longest text times the languages. If a
    column in keep has the name of a result, the result's is made longer by an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    beside = Beside(docs, keep, [text_of(quoted(text_col))], {"lang_pred": "string", "score": "double", "spans": "array<struct<start:int,end:int,lang:string>>"})
    kept, names, limit = beside.kept, beside.names, SIDE_BY_SIDE // max(1, len(model.langs))

    def run(batches):
        m = sent.value
        for batch in released(batches):
            texts, rest = batch.column(kept).to_pylist(), batch.select(range(kept))
            for i, j in pieces(texts, limit):
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, *label(m, texts[i:j])], names)

    return beside.map(run)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(m: Model, texts: list[str]) -> list[pa.Array]:
    """lang_pred, score and spans of texts."""
    if not m.langs:
        return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), SPANS)]
    scores, sizes, starts, bounds, n = [], [], [], [np.zeros(1, np.int64)], 0
    for i, j in pieces(texts, LETTERS):
        x = Letters(texts[i:j])
        scores.append(m.words(x))
        sizes.append(x.size)
        doc = np.searchsorted(x.bound, np.arange(len(x.start)), "right") - 1
        starts.append(x.start - x.base[doc])
        bounds.append(x.bound[1:] + n)
        n += len(x.start)
    bound = np.concatenate(bounds)
    if not n:
        return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), SPANS)]
    size, start = np.concatenate(sizes), np.concatenate(starts)
    path = viterbi(np.concatenate(scores), bound)
    doc = np.repeat(np.arange(len(texts)), np.diff(bound))
    letters = np.bincount(doc * len(m.langs) + path, size, len(texts) * len(m.langs)).reshape(len(texts), -1)
    total = letters.sum(1)
    top = letters.argmax(1)
    score = letters[np.arange(len(texts)), top] / np.maximum(total, 1)
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    end = np.concatenate([new[1:], [len(path)]]) - 1
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(new.tolist(), end.tolist(), strict=True):
        spans[doc[a]].append({"start": int(start[a]), "end": int(start[b] + size[b]), "lang": m.langs[path[a]]})
    return [pa.array([m.langs[k] if t else "und" for k, t in zip(top, total, strict=True)]), pa.array(score), pa.array(spans, SPANS)]
