"""Byte-level BPE encoding and decoding in padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pieces, quoted, released, text_of

#: Pieces of more bytes are merged with a heap, by the same rule, so that one huge piece costs n log n.
MATRIX_BYTES = 512
#: Distinct pieces that a task keeps encoded.
CACHE_PIECES = 150_000
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text, from the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str | os.PathLike) -> list[tuple[bytes, int]]:
    """(token, rank) pairs of a rank file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))]


class Codec:
    """Encodes and decodes byte pieces by merge ranks."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str) -> None:
        self.rank = dict(ranks)
        self.split = regex.compile(pattern).findall
        self.vocab = {r: t for t, r in ranks}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, r in ranks:
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = r
        self._build(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cache: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pairs, filled for all keys at once."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] < 0
            slot, i = np.unique(at[left][free], return_index=True)
            won = left[free][i]
            self.keys[slot], self.values[slot] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, NONE where the pair doesn't merge."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        todo = np.flatnonzero((out == NONE) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]] == keys[todo]
            out[todo[found]] = self.values[at[todo[found]]]
            todo = todo[~found & (self.keys[at[todo]] >= 0)]
        return out

    def _matrix(self, rows: list[bytes]) -> list[bytes]:
        """Merge rows of about one length: in each round every row merges its leftmost pair of least rank."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(n.max())
        live = np.arange(width) < n[:, None]
        ids = np.zeros((len(rows), width), np.int32)
        ids[live] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), max(1, width - 1)), NONE, np.int32)
        pair = live[:, 1:]
        rank[:, : width - 1][pair] = self.pair_rank(ids[:, :-1][pair], ids[:, 1:][pair])
        out: list[bytes] = [b""] * len(rows)
        at = np.arange(len(rows))
        while len(at):
            p = rank.argmin(1)
            row = np.arange(len(at))
            best = rank[row, p]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[at[r]] = ids[r, : n[r]].tobytes()
                keep = ~done
                at, ids, rank, n, p, best = at[keep], ids[keep], rank[keep], n[keep], p[keep], best[keep]
                if not len(at):
                    break
                width = int(n.max())
                ids, rank, row = ids[:, :width], rank[:, : width - 1], np.arange(len(at))
            ids[row, p] = best
            col = np.arange(width - 1)
            ids = np.take_along_axis(ids, col + (col > p[:, None]), 1)
            n = n - 1
            if width < 3:
                rank = np.full((len(at), 1), NONE, np.int32)
                continue
            col = np.arange(width - 2)
            rank = np.take_along_axis(rank, col + (col > p[:, None] - 1), 1)
            width -= 1
            for q, ok in ((p - 1, p > 0), (p, p + 1 < n)):
                r = np.flatnonzero(ok)
                rank[r, q[r]] = self.pair_rank(ids[r, q[r]], ids[r, q[r] + 1])
            r = np.flatnonzero((p + 1 >= n) & (p < width - 1))
            rank[r, p[r]] = NONE
        return out

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        first = self.pair_rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before, now = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], first.tolist() + [int(NONE)]
        rank_of = lambda i: int(self.pair_rank(np.array([ids[i]]), np.array([ids[after[i]]]))[0]) if after[i] >= 0 else int(NONE)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or now[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = rank_of(k)
                    if now[k] != NONE:
                        heapq.heappush(heap, (now[k], k))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def learn(self, tokens: set[str]) -> None:
        """Put distinct pieces into the cache, bucketed by length."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for t in tokens:
            b = t.encode()
            r = self.rank.get(b)
            if r is not None:
                self.cache[t] = r.to_bytes(4, "little")
            elif len(b) > MATRIX_BYTES:
                self.cache[t] = self._heap(b)
            else:
                rows.setdefault(max(2, (len(b) - 1).bit_length() * 4 + ((len(b) - 1) >> max(0, (len(b) - 1).bit_length() - 3) & 3)), []).append((t, b))
        for bucket in rows.values():
            step = max(1, 200_000 // max(len(b) for _, b in bucket))
            for i in range(0, len(bucket), step):
                part = bucket[i : i + step]
                self.cache.update(zip((t for t, _ in part), self._matrix([b for _, b in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        fresh = set(itertools.chain.from_iterable(split))
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        self.learn(fresh.difference(self.cache))
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(name: str, sent, pattern: str) -> Codec:
    """The codec of a vocabulary; a Python worker keeps the last one from task to task."""
    if (name, pattern) not in _codecs:
        _codecs.clear()
        _codecs[name, pattern] = Codec(sent.value, pattern)
    return _codecs[name, pattern]


def encode_decode(docs: DataFrame, id_cols: list[str], text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decode: bool = True) -> DataFrame:
    """id_cols plus n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the decoded bytes).

    Every whole text is encoded, each match of the pattern by itself, without special tokens; a null
    text is empty and has no ids. Rows pass one by one, so ties and repeated rows need no rule, and an empty table gives an empty one. id_cols may
    have any names but `ids` and `decoded`; one called `n_tokens` comes back under that name, and the count is then left out. The rank file is read on
    the driver and broadcast (its size is that of a vocabulary, whatever the data).
    """
    spark = docs.sparkSession
    path, default = default_vocabulary() if ranks_path is None or pattern is None else (ranks_path, pattern)
    pattern, ranks = pattern or default, read_ranks(ranks_path or path)
    name, sent = hashlib.sha256(repr(ranks).encode()).hexdigest(), spark.sparkContext.broadcast(ranks)
    named = {f"c{i}": c for i, c in enumerate(id_cols)}
    rows = docs.select(*[F.col(quoted(c)).alias(k) for k, c in named.items()], text_of(quoted(text_col)).alias("text"))

    def run(batches):
        codec = _codec(name, sent, pattern)
        for batch in released(batches):
            texts = batch.column("text").to_pylist()
            rest = batch.drop_columns(["text"])
            for i, j in pieces(texts, 1_000_000):
                ids = codec.encode(texts[i:j])
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids) if decode else [None] * (j - i), pa.binary())]
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).columns, *cols], [*rest.schema.names, "n_tokens", "ids", "decoded"])

    schema = StructType(rows.schema.fields[:-1]).add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")
    coded = rows.mapInArrow(run, schema)
    return coded.select(*[F.col(k).alias(c) for k, c in named.items()], *[c for c in ("n_tokens", "ids", "decoded") if c not in id_cols])
