"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .common import Beside, Scratch, Words, pieces, quoted, released, text_of
from .samples import labelled_sample

#: Labelled documents of each class that are learnt from, and characters of all of them together, about.
PER_CLASS, MOST_CHARS = 3000, 60_000_000
WORD_BITS = 15
FACTORS = 6
BINS = 16
STATS = 14
FEATURES = (1 << WORD_BITS) + STATS * BINS
EPOCHS = 6
#: Words of fewer learnt texts weigh nothing.
LEAST_TEXTS = 3

_kind = np.zeros((5, 256), bool)
_kind[0, ord("A") : ord("Z") + 1] = True
_kind[1, ord("a") : ord("z") + 1] = True
_kind[1, 128:] = True
_kind[2, ord("0") : ord("9") + 1] = True
_kind[3, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
_kind[4, ord("\n")] = True


def _ratio_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, (np.sqrt(np.clip(x, 0, 1)) * BINS).astype(np.int64))


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(x, 0) + 1), 0, BINS - 1).astype(np.int64)


def features(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of whole texts, ordered by row: words with their damped, normalised counts, and binned statistics."""
    w = Words(texts)
    n = len(texts)
    a = np.frombuffer(w.buf, np.uint8)
    counts = []
    for k in range(5):
        c = np.concatenate([[0], np.cumsum(_kind[k][a], dtype=np.int64)])
        counts.append(c[w.base[1:] - 1] - c[w.base[:-1]])
    upper, lower, digit, mark, lines = counts
    size = np.maximum(1, w.base[1:] - 1 - w.base[:-1])
    words = w.last - w.first
    h = w.hashes()
    doc = np.repeat(np.arange(n), words)
    least = np.maximum(1, words)
    bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, tf = np.unique((doc << WORD_BITS) | bucket, return_counts=True)
    row, feat = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.log1p(tf)
    value = value / np.sqrt(np.maximum(1e-9, np.bincount(row, value * value, n)))[row]
    same = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), n) if len(h) else np.zeros(n)
    odd_end = np.bincount(doc, _kind[3][a[w.end - 1]] & ~np.isin(a[w.end - 1], [ord(c) for c in ".,;:?'\")"]), n)
    short = np.bincount(doc, w.end - w.start <= 2, n)
    top = np.zeros(n)
    np.maximum.at(top, row, tf)
    distinct = np.bincount(row, minlength=n)
    shout = np.bincount(doc, _kind[0][a[w.start]] & _kind[0][a[np.minimum(w.start + 1, w.end - 1)]], n)
    meta = np.array([-1 if c is None else c for c in n_chars], float)
    stats = [
        _ratio_bin(upper / np.maximum(1, upper + lower)), _ratio_bin(digit / size), _ratio_bin(mark / size), _ratio_bin(np.minimum(1, lines / least)),
        _ratio_bin(distinct / least), _ratio_bin(same / least), _ratio_bin(odd_end / least), _ratio_bin(short / least), _ratio_bin(top / least),
        _ratio_bin(shout / least), _log_bin(words), _log_bin(2 * (upper + lower + digit + mark) / least), _log_bin((words / np.maximum(1, lines + 1))), np.where(meta < 0, BINS - 1, np.minimum(BINS - 2, _log_bin(np.maximum(meta, 0)))),
    ]
    s = np.stack(stats, 1) + (1 << WORD_BITS) + np.arange(STATS) * BINS
    row = np.concatenate([row, np.repeat(np.arange(n), STATS)])
    feat = np.concatenate([feat, s.ravel()])
    value = np.concatenate([value, np.full(n * STATS, 0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], feat[order], value[order].astype(np.float32)


@dataclass
class Machine:
    """y = w0 + sum w x + 1/2 sum over factors of (sum v x)^2 - sum v^2 x^2."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, row: np.ndarray, feat: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[feat] * value[:, None]
        first = np.searchsorted(row, np.arange(n))  # every row has its statistics
        s = np.add.reduceat(vx, first)
        pair = 0.5 * (s * s - np.add.reduceat(vx * vx, first)).sum(1)
        return self.w0 + np.add.reduceat(self.w[feat] * value, first) + pair, s, vx

    def score(self, row: np.ndarray, feat: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        y = np.clip(self.raw(row, feat, value, n)[0].astype(np.float64), -30, 30)
        return 1 / (1 + np.exp(-y))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, float]], epochs: int = EPOCHS, seed: int = 3) -> Machine:
    """Adam on the log loss of (features, values, label, weight) rows; with one class or none the score is constant."""
    rnd = np.random.default_rng(seed)
    total = sum(r[3] for r in rows)
    prior = (sum(r[3] for r in rows if r[2]) + 1) / (total + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(FEATURES, np.float32), rnd.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    if len({r[2] for r in rows}) < 2:
        m.v[:] = 0
        return m
    held = np.bincount(np.concatenate([r[0] for r in rows]), minlength=FEATURES)
    known = (held >= LEAST_TEXTS) | (np.arange(FEATURES) >= 1 << WORD_BITS) & (held > 0)
    m.v[~known] = 0
    rows = [(r[0][k], r[1][k], *r[2:]) for r in rows for k in (known[r[0]],)]
    params = [m.w, m.v]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    mean, step = total / len(rows), 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        order = rnd.permutation(len(rows))
        for i in range(0, len(rows), 128):
            part = [rows[k] for k in order[i : i + 128]]
            row = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            feat, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            y, weight = np.array([r[2] for r in part]), np.array([r[3] for r in part]) / mean
            raw, s, vx = m.raw(row, feat, value, len(part))
            g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * weight / len(part)).astype(np.float32)
            gx = g[row] * value
            gv = gx[:, None] * (s[row] - vx)
            grads = [np.bincount(feat, gx, FEATURES), np.stack([np.bincount(feat, gv[:, f], FEATURES) for f in range(FACTORS)], 1)]
            step += 1
            m.w0 -= 0.1 * rate * float(g.sum())
            for p, grad, (a, b) in zip(params, grads, moment, strict=True):
                grad = grad.astype(np.float32) + 1e-5 * p
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return m


def _batches(batches, build):
    """The last two columns are texts and lengths."""
    for batch in released(batches):
        last = batch.num_columns - 2
        texts = [t.encode() for t in batch.column(last).to_pylist()]
        chars = batch.column(last + 1).to_pylist()
        rest = batch.select(range(last))
        for i, j in pieces(texts):
            yield from build(rest.slice(i, j - i), *features(texts[i:j], chars[i:j]), j - i)


def _chars(chars_col: str | None) -> Column:
    return (F.col(quoted(chars_col)).cast("long") if chars_col else F.lit(None).cast("long")).alias("_chars")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", text_col: str = "text", chars_col: str | None = "n_chars", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Machine:
    """Fit on a bounded sample of the labelled rows that learn marks (see samples.labelled_sample): about per_class whole texts of each class and
    most_chars characters. Features are made on the executors; at least one row of each class is learnt from."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = labelled_sample(docs, labels, label_col, learn, per_class, most_chars, [_chars(chars_col)], scratch, text_col=text_col)
    sample = sample.select("y", "share", F.col("text").alias("_text"), "_chars")

    def run(batches):
        def build(rest, row, feat, value, n):
            edge = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            cols = [pa.ListArray.from_arrays(edge, pa.array(feat.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(value))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *cols], ["y", "share", "feat", "value"])

        yield from _batches(batches, build)

    got = sample.mapInArrow(run, "y int, share double, feat array<int>, value array<float>").toPandas()
    return fit([(np.asarray(f), np.asarray(v), int(y), 1 / s) for y, s, f, v in got.itertuples(index=False)])


def score(docs: DataFrame, model: Machine, keep: list[Column], text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The columns in keep and score (0 to 1, higher: the label 1 is likelier) of every whole text.

    A null text is empty; texts without words are scored by their statistics alone, and if there was nothing to learn from, or one class only, all
    texts get one constant. Rows are scored one by one, so ties and repeated rows need no rule; an empty table gives an empty one. A column in keep that is
    called score stays, and the result's name is made longer by an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    beside = Beside(docs, keep, [text_of(quoted(text_col)), _chars(chars_col)], {"score": "double"})
    names = beside.names

    def run(batches):
        def build(rest, row, feat, value, n):
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sent.value.score(row, feat, value, n))], names)

        yield from _batches(batches, build)

    return beside.map(run)
