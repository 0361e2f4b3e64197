"""Shared pieces: byte-level word splitting and hashing in numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.names import quoted, unused
from ..operators.scratch import Scratch

__all__ = ["Beside", "Scratch", "WORD", "Words", "crc_mod", "key64", "mix", "pieces", "quoted", "released", "text_of", "unused"]

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"

U64 = np.uint64
_P1, _P2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not the GNU library
        return lambda keep: None


def released(batches):
    """Pass batches on; at the end, give freed memory back, since Spark keeps its Python workers for later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    _trim()(0)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def pieces(texts: list[bytes], limit: int = 4_000_000):
    """Yield (first, last) ranges of texts of about limit bytes together, at least one text each."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = h ^ (h >> U64(32))
    h = h * _P1
    h = h ^ (h >> U64(29))
    h = h * _P2
    return h ^ (h >> U64(32))


class Beside:
    """Columns that stay (keep) and columns that a map over Arrow batches adds to them (results: name -> type), whatever the names of the former.

    The map reads columns called c0, c1, .. (those in keep, then inputs) and yields batches of the kept ones and the results, called names. A result whose
    name a kept column has gets a longer one.
    """

    def __init__(self, docs: DataFrame, keep: Sequence[Column], inputs: Sequence[Column], results: dict[str, str]) -> None:
        kept = docs.select(*keep)
        n = len(kept.columns)
        self.rows = docs.select(*keep, *inputs).toDF(*[f"c{i}" for i in range(n + len(inputs))])
        self.kept, self.names = n, [*[f"c{i}" for i in range(n)], *[f"r{i}" for i in range(len(results))]]
        self.final = [*kept.columns, *unused(kept, *results)]
        added = StructType.fromDDL(", ".join(f"{r} {kind}" for r, kind in zip(self.names[n:], results.values(), strict=True)))
        self.schema = StructType([*self.rows.schema.fields[:n], *added.fields])

    def map(self, run) -> DataFrame:
        return self.rows.mapInArrow(run, self.schema).toDF(*self.final)


class Words:
    """The words of several texts: byte ranges in one buffer, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = b"\n".join(texts) + b"\n" * 9
        a = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[a]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(a) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(size)])
        self.first = np.searchsorted(self.start, self.base[:-1])
        self.last = np.searchsorted(self.start, self.base[1:])

    def hashes(self, long_from: int = 64) -> np.ndarray:
        n = self.end - self.start
        view = np.ndarray((len(self.buf) - 8,), "<u8", self.buf, 0, (1,))
        h = mix(n.astype(U64) + _P2)
        live, k = np.flatnonzero(n <= long_from), 0
        while len(live):
            left = n[live] - 8 * k
            part = view[self.start[live] + 8 * k] & _MASK[np.minimum(left, 8)]
            x = (h[live] ^ part) * _P1
            h[live] = x ^ (x >> U64(31))
            k += 1
            live = live[left > 8]
        for i in np.flatnonzero(n > long_from):
            h[i] = xxhash.xxh64_intdigest(self.buf[self.start[i] : self.end[i]])
        return mix(h)


def key64(*cols: Column) -> Column:
    """A signed 64-bit hash of columns, JVM-side."""
    return F.xxhash64(*cols)
