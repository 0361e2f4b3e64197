"""SetSketch registers of shingle sets: building, banding and joint estimation (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Words, mix

#: Registers, and registers in a band.
REGISTERS, PER_BAND = 128, 4
#: Base of the exponential spacing, rate of the exponential variables, and largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1

_rnd = np.random.default_rng(20_240_901)
_A = (_rnd.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rnd.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


class Shingles:
    """The distinct shingles of lower-cased texts, as sorted 64-bit hashes, text after text."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        w = Words([t.lower() for t in texts])
        h = w.hashes()
        words = w.last - w.first
        n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(len(texts)), n)
        at = np.repeat(w.first - (np.cumsum(n) - n), n) + np.arange(len(doc))
        left = w.last[doc] - at
        s = np.zeros(len(at), np.uint64)
        for k in range(size):
            inside = left > k
            part = mix(s + h[np.minimum(at + k, max(0, len(h) - 1))] + np.uint64(k + 1)) if len(h) else s
            s = np.where(inside, part, s)
        order = np.argsort(s)
        order = order[np.argsort(doc[order].astype(np.uint32 if len(texts) > 65535 else np.uint16), kind="stable")]
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        self.hash, doc = s[new], doc[new]
        self.bound = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.n = np.diff(self.bound)

    def set_hashes(self) -> np.ndarray:
        """Two signed 64-bit hashes of each set."""
        b = self.bound
        raw = b"".join(xxhash.xxh3_128_digest(self.hash[b[i] : b[i + 1]].tobytes()) for i in range(len(self.n)))
        return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)

    def registers(self) -> np.ndarray:
        """(sets, REGISTERS) of the sets that aren't empty: truncated, exponentially spaced minima."""
        some = self.bound[:-1][self.n > 0]
        least = np.empty((REGISTERS, len(some)), np.uint32)
        if len(some):
            x = (self.hash >> np.uint64(32)).astype(np.uint32)
            for i in range(REGISTERS):
                least[i] = np.minimum.reduceat(x * _A[i] + _B[i], some)
        return spaced(least.T)


def spaced(least: np.ndarray) -> np.ndarray:
    """Register values of uniform 32-bit minima: floor(1 - log_b h) of the exponential variable h, truncated.

    The registers of a union are the larger ones of its parts.
    """
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """(sets, bands) signed keys of the register values in each band."""
    four = np.ascontiguousarray(registers, "<u2").view("<u8")
    return mix(mix(four) + np.arange(1, four.shape[1] + 1, dtype=np.uint64)).view(np.int64)


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets by likelihood, from the numbers of registers that are larger, smaller and equal.

    With u and v the sets' shares of n_a + n_b, a register of the first is larger with probability p(u - v J),
    smaller with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b); the likelihood is maximised over a grid of J.
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_GRID, np.minimum(u / v, v / u))
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    more, less = p(u - v * j), p(v - u * j)
    d_more, d_less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    likelihood = d_more * np.log(more) + d_less * np.log(less) + (REGISTERS - d_more - d_less) * np.log(np.clip(1 - more - less, 1e-9, 1))
    return j[np.arange(len(j)), likelihood.argmax(1)]
