"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all overlapping windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .common import Beside, Scratch, pieces, quoted, released, text_of
from .langid import Letters
from .samples import labelled_sample

#: Labelled documents of each class that are learnt from, and characters of all of them together, about.
PER_CLASS, MOST_CHARS = 1500, 30_000_000
#: Words of a window, and words from one window's start to the next: any 24 words in a row are in one window.
WINDOW, STRIDE = 48, 24
WORD_BITS, CHAR_BITS = 20, 16
#: Words and n-grams in fewer of the learnt texts have no vector of their own.
LEAST_TEXTS = 5
#: Pseudo-texts, mixed like the learnt ones, that damp the log odds of rare words.
DAMP = 10.0
DIM, HIDDEN = 8, 8
EPOCHS, BATCH = 8, 256
#: Steps of the optimiser at least; small samples are gone through more often, up to so many times, until the loss of a pass has settled.
LEAST_STEPS, MOST_EPOCHS, SETTLED = 300, 60, 0.005
#: Windows of a clean document that are learnt from: the most suspect one and this many others.
OTHERS = 2


class Inputs:
    """The words of several texts as hashed word ids and hashed letter n-grams (three and four letters with word ends)."""

    def __init__(self, texts: list[str]) -> None:
        x = Letters(texts)
        self.n = len(x.start)
        self.bound = x.bound
        self.word_at, self.size = x.word_at, x.size
        if self.n:
            mixed = (x.buckets[2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x.buckets[1] * np.uint64(0xC2B2AE3D27D4EB4F))
            whole = np.add.reduceat(mixed, x.word_at) * np.uint64(0xD6E8FEB86659FD93)
            self.word = (whole >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        else:
            self.word = np.zeros(0, np.int32)
        self.grams = [x.buckets[k].astype(np.int32) for k in (1, 2)]

    @staticmethod
    def join(parts: list[Inputs]) -> Inputs:
        """The parts one after the other."""
        out = Inputs([])
        out.n = sum(x.n for x in parts)
        out.word = np.concatenate([x.word for x in parts])
        out.grams = [np.concatenate([x.grams[k] for x in parts]) for k in (0, 1)]
        out.size = np.concatenate([x.size for x in parts]).astype(np.int32)
        out.word_at = np.cumsum(out.size, dtype=np.int64) - out.size
        shift = np.cumsum([0, *(x.n for x in parts)])
        out.bound = np.concatenate([[0], *(x.bound[1:] + n for x, n in zip(parts, shift[:-1], strict=True))])
        return out

    def known(self, rows: dict[str, np.ndarray]) -> Inputs:
        """Replace hashes by the rows of their vectors, row 0 for those without one."""
        self.word = rows["word"][self.word]
        self.grams = [rows[k][g] for k, g in zip(("three", "four"), self.grams, strict=True)]
        return self

    def letters(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters of some words: indices, where each word's begin, and how many they are."""
        size = self.size[words].astype(np.int64)
        edge = np.cumsum(size) - size
        return np.repeat(self.word_at[words] - edge, size) + np.arange(size.sum()), edge, size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of all windows; the last of a text ends with it, and a text with few words has one window."""
        words = np.diff(self.bound)
        n = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(words)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = np.minimum(k * STRIDE, np.maximum(0, words[doc] - WINDOW)) + self.bound[doc]
        return doc, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * np.clip(x, -15, 15))) - 1


@dataclass
class Network:
    p: dict[str, np.ndarray]
    rows: dict[str, np.ndarray]  # hash -> row of the vectors word, three and four

    def vectors(self, x: Inputs) -> np.ndarray:
        """(words, DIM): the word's vector and the mean of its n-grams' vectors, side by side."""
        if not x.n:
            return np.zeros((0, 2 * DIM), np.float32)
        chars = np.add.reduceat(self.p["three"][x.grams[0]] + self.p["four"][x.grams[1]], x.word_at) / x.size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word], chars], 1)

    def vectors_of(self, x: Inputs, at: np.ndarray) -> np.ndarray:
        """The vectors of the words at some places only."""
        words, inverse = np.unique(at, return_inverse=True)
        letters, edge, size = x.letters(words)
        chars = np.add.reduceat(self.p["three"][x.grams[0][letters]] + self.p["four"][x.grams[1][letters]], edge) / size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word[words]], chars], 1)[inverse.reshape(at.shape)]

    def forward(self, e: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from inputs (steps, windows, 2 DIM) and a mask (steps, windows) of real words."""
        steps, n, _ = e.shape
        memory, states = [], []
        for way in "fb":
            wx, wh, b = self.p[f"{way}x"], self.p[f"{way}h"], self.p[f"{way}b"]
            gx = (e.reshape(steps * n, -1) @ wx).reshape(steps, n, -1) + b
            h = np.zeros((n, HIDDEN), np.float32)
            out = np.empty((steps, n, HIDDEN), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                rz = _sigmoid(gx[t, :, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                u = h @ wh[:, 2 * HIDDEN :]
                c = _tanh(gx[t, :, 2 * HIDDEN :] + r * u)
                m = mask[t, :, None]
                new = h + m * (1 - z) * (c - h)
                if keep:
                    memory.append((way, t, h, r, z, u, c, m))
                h = new
                out[t] = h
            states.append(out)
        s = np.concatenate(states, 2)
        a = s @ self.p["att"] + np.where(mask > 0, np.float32(0), np.float32(-1e4))
        a = np.exp(a - a.max(0))
        a = a / a.sum(0)
        pooled = (a[:, :, None] * s).sum(0)
        y = pooled @ self.p["out"] + self.p["bias"][0]
        return (y, s, a, pooled, memory) if keep else y

    def gradients(self, e: np.ndarray, mask: np.ndarray, dy_of) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the parameters and of e; dy_of maps logits to (loss, gradient)."""
        y, s, a, pooled, memory = self.forward(e, mask, True)
        loss, dy = dy_of(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "three", "four")}
        g["bias"][0], g["out"] = dy.sum(), pooled.T @ dy
        dpool = dy[:, None] * self.p["out"]
        da = (s * dpool).sum(2)
        dlogit = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", dlogit, s)
        ds = a[:, :, None] * dpool + dlogit[:, :, None] * self.p["att"]
        de = np.zeros_like(e)
        dh = {"f": np.zeros((e.shape[1], HIDDEN), np.float32), "b": np.zeros((e.shape[1], HIDDEN), np.float32)}
        for way, t, h, r, z, u, c, m in reversed(memory):
            wx, wh = self.p[f"{way}x"], self.p[f"{way}h"]
            d = dh[way] + ds[t, :, :HIDDEN] if way == "f" else dh[way] + ds[t, :, HIDDEN:]
            dc = d * m * (1 - z) * (1 - c * c)
            dz = -d * m * (c - h) * z * (1 - z)
            du = dc * r
            dr = dc * u * r * (1 - r)
            drz = np.concatenate([dr, dz], 1)
            dgate = np.concatenate([drz, dc], 1)
            g[f"{way}b"] += dgate.sum(0)
            g[f"{way}x"] += e[t].T @ dgate
            g[f"{way}h"][:, : 2 * HIDDEN] += h.T @ drz
            g[f"{way}h"][:, 2 * HIDDEN :] += h.T @ du
            de[t] += dgate @ wx.T
            dh[way] = d * (1 - m * (1 - z)) + drz @ wh[:, : 2 * HIDDEN].T + du @ wh[:, 2 * HIDDEN :].T
        return g, de, loss

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text: that of its most toxic window; the prior of a window for texts without words."""
        out = np.full(len(texts), float(_sigmoid(self.p["prior"][0])))
        if self.p["out"].any():
            for i, j in pieces(texts, 1_000_000):
                x = Inputs(texts[i:j]).known(self.rows)
                doc, first = x.windows()
                e = self.vectors(x)
                top = np.full(j - i, -np.inf)
                for a in range(0, len(doc), 1024):
                    at, mask = _steps(x, doc[a : a + 1024], first[a : a + 1024])
                    np.maximum.at(top, doc[a : a + 1024], self.forward(e[at], mask))
                some = np.isfinite(top)
                out[i:j][some] = _sigmoid(top[some])
        return out


def _steps(x: Inputs, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices (steps, windows) and the mask of those inside their text."""
    at = first + np.arange(WINDOW)[:, None]
    mask = at < x.bound[doc + 1]
    return np.minimum(at, max(0, x.n - 1)), mask.astype(np.float32)


def _texts_with(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """How many toxic texts and how many texts hold each id."""
    pair = np.unique(doc.astype(np.int64) * size + ids)
    return np.stack([np.bincount(pair % size, y[pair // size], size), np.bincount(pair % size, minlength=size)])


def _log_odds(pos: np.ndarray, every: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Damped log of how much likelier toxic texts hold each id than clean ones."""
    p, n = y.sum(), (1 - y).sum()
    return np.log((pos + DAMP * p / len(y)) / p) - np.log((every - pos + DAMP * n / len(y)) / n)


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Network:
    """Learn from labelled texts. A toxic text gives its most suspect windows, by log odds of its words; a clean one, that and others."""
    rnd = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    small = lambda *shape: rnd.normal(0, 0.3, shape).astype(np.float32)
    prior = (y.sum() + 1) / (len(y) + 2)
    p = {k: np.zeros(n, np.float32) for k, n in (("fb", 3 * HIDDEN), ("bb", 3 * HIDDEN), ("bias", 1))}
    p["prior"] = np.array([np.log(prior / (1 - prior)) - 2], np.float32)
    p |= {k: small(2 * DIM, 3 * HIDDEN) for k in ("fx", "bx")} | {k: small(HIDDEN, 3 * HIDDEN) for k in ("fh", "bh")} | {"att": small(2 * HIDDEN), "out": small(2 * HIDDEN)}
    sizes = {"word": 1 << WORD_BITS, "three": 1 << CHAR_BITS, "four": 1 << CHAR_BITS}
    net = Network(p, {k: np.zeros(n, np.int32) for k, n in sizes.items()})
    p |= {k: np.zeros((1, DIM), np.float32) for k in sizes}
    if not 0 < y.sum() < len(y):
        p["out"][:] = 0
        return net
    parts, held = [], {k: np.zeros((2, n)) for k, n in sizes.items()}
    for i, j in pieces(texts, 1_000_000):
        x = Inputs(texts[i:j])
        parts.append(x)
        doc = np.repeat(np.arange(j - i), np.diff(x.bound))
        letter_doc = np.repeat(doc, x.size)
        for k, ids, d in (("word", x.word, doc), ("three", x.grams[0], letter_doc), ("four", x.grams[1], letter_doc)):
            held[k] += _texts_with(ids, d, y[i:j], sizes[k])
    odds = {}
    for k, (pos, every) in held.items():
        own = np.flatnonzero(every >= LEAST_TEXTS)
        net.rows[k][own] = np.arange(1, len(own) + 1)
        odds[k] = np.concatenate([[0], _log_odds(pos, every, y)[own]])
        p[k] = small(len(own) + 1, DIM) * 0.1
        p[k][:, 0] = np.clip(odds[k], -2, 4) / 2
        p[k][0] = 0
    x = Inputs.join(parts).known(net.rows)
    del parts, held
    doc, first = x.windows()
    suspect = np.maximum(odds["word"][x.word], np.maximum.reduceat(odds["four"][x.grams[1]], x.word_at))

    def by_odds(a: int, b: int) -> np.ndarray:
        at, mask = _steps(x, doc[a:b], first[a:b])
        return np.where(mask > 0, suspect[at], -9).max(0)

    def by_network(a: int, b: int) -> np.ndarray:
        at, mask = _steps(x, doc[a:b], first[a:b])
        return net.forward(net.vectors_of(x, at), mask)

    def strength(of) -> np.ndarray:
        return np.concatenate([of(a, a + 1024) for a in range(0, len(doc), 1024)])

    def chosen(s: np.ndarray) -> np.ndarray:
        """The windows to learn from: the most suspect of each text, and others of clean ones."""
        s = s + rnd.random(len(doc)) * 1e-3
        order = np.lexsort((-s, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        other = rnd.random(len(doc)) * np.bincount(doc)[doc] < OTHERS
        return np.flatnonzero((rank == 0) | ((y[doc] == 0) & ((rank == 1) | other)))

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k != "prior"}
    step, epoch, most = 0, 0, epochs
    suspects = strength(by_odds)
    while epoch < most:
        if epoch and not epoch & (epoch - 1):  # after 1, 2, 4, ... passes the network itself says which windows are suspect
            suspects = strength(by_network)
        use, losses = chosen(suspects), []
        if epoch == 0:
            most = max(epochs, min(MOST_EPOCHS, -(-LEAST_STEPS // max(1, -(-len(use) // BATCH)))))
        target = y[doc[use]].astype(np.float32)
        shuffled = rnd.permutation(len(use))
        for i in range(0, len(use), BATCH):
            own = shuffled[i : i + BATCH]
            w = use[own]
            at, mask = _steps(x, doc[w], first[w])
            words, inverse = np.unique(at, return_inverse=True)
            letters, edge, size = x.letters(words)
            g3, g4 = x.grams[0][letters], x.grams[1][letters]
            c = np.add.reduceat(p["three"][g3] + p["four"][g4], edge) / size[:, None].astype(np.float32)
            seen = (rnd.random((len(words), 1)) < 0.7).astype(np.float32)  # now and then a word must do with its letters
            e = np.concatenate([p["word"][x.word[words]] * seen, c], 1)[inverse.reshape(at.shape)]

            def loss(logit, own=own, target=target):
                q = _sigmoid(logit)
                return float(-np.log(np.where(target[own] > 0, q, 1 - q) + 1e-9).mean()), ((q - target[own]) / len(own)).astype(np.float32)

            g, de, missed = net.gradients(e, mask, loss)
            losses.append(missed)
            dw = np.stack([np.bincount(inverse.ravel(), de[:, :, k].ravel(), len(words)) for k in range(2 * DIM)], 1)
            dc = np.repeat(dw[:, DIM:] / size[:, None], size, 0)
            dw[:, :DIM] *= seen
            g["word"] = np.stack([np.bincount(x.word[words], dw[:, k], len(p["word"])) for k in range(DIM)], 1)
            g["three"] = np.stack([np.bincount(g3, dc[:, k], len(p["three"])) for k in range(DIM)], 1)
            g["four"] = np.stack([np.bincount(g4, dc[:, k], len(p["four"])) for k in range(DIM)], 1)
            for k in sizes:
                g[k][0] = 0
            step += 1
            rate = 0.01 * (1 - epoch / most) + 0.0005
            for k, (a, b) in moments.items():
                grad = g[k].astype(np.float32)
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        epoch += 1
        if np.mean(losses) < SETTLED:
            break
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Network:
    """Fit on a bounded sample of the labelled rows that learn marks (see samples.labelled_sample): about per_class whole texts of each class and
    most_chars characters. At least one row of each class is learnt from."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    few = labelled_sample(docs, labels, label_col, learn, per_class, most_chars, [], scratch, text_col=text_col).select("y", "text").toPandas()
    few = few.sort_values(["text", "y"], kind="stable")
    return fit(few["text"].tolist(), few["y"].tolist())


def score(docs: DataFrame, model: Network, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns in keep and score (0 to 1, higher: toxic is likelier): the most toxic of all overlapping windows.

    A text that is null, empty or without letters has no window and gets a low constant. If there was nothing to
    learn from, or one class only, all texts get it. Rows are scored one by one, so ties and repeated rows need no rule; an empty
    table gives an empty one. A column in keep that is called score stays, and the result's name is made longer by an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    beside = Beside(docs, keep, [text_of(quoted(text_col))], {"score": "double"})
    kept, names = beside.kept, beside.names

    def run(batches):
        for batch in released(batches):
            texts, rest = batch.column(kept).to_pylist(), batch.select(range(kept))
            for i, j in pieces(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, pa.array(sent.value.scores(texts[i:j]))], names)

    return beside.map(run)
