"""64-bit hashes of words and of runs of words, for a whole slice of texts at once.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. Its hash is a polynomial over its bytes, taken from one running
sum over the slice, and then mixed; words of over 256 bytes are hashed by blake2b instead, as polynomials modulo 2^64
are only safe on short strings. A run of k words is hashed in the same way over the hashes of its words.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from portolan.llm.support import KEPT

LONG_WORD = 256
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT.append(_POWERS.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; the base is odd."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)

        def up(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        known = (up(base), up(pow(base, -1, 1 << 64)))
        if size <= 1 << 22:  # tables of a giant text are not kept
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


@lru_cache(1)
def byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 7)


class Words:
    """The words of a slice of texts: hash, text number, and the number of words of each text."""

    def __init__(self, column: pa.Array):
        data = column.cast(pa.binary()).to_pylist()
        sizes = np.fromiter((len(x) for x in data), np.int64, len(data))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = b"\n".join(data) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate([[1], gap.view(np.int8)]))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(BYTE_BASE, len(raw))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[raw] * up, dtype=np.uint64)])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] if len(self.start) else np.zeros(0, np.uint64))
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            digest = hashlib.blake2b(joined[self.start[i] : self.end[i]], digest_size=8).digest()
            self.hash[i] = int.from_bytes(digest, "little")
        bounds = np.searchsorted(self.start, begins)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(data)), self.count)
        self.joined = joined

    def runs(self, k: int, base: int = WORD_BASE) -> np.ndarray:
        """Hashes of the k words from each word on; only those with `within(k)` lie in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = powers(base, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up, dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1], k)

    def within(self, k: int) -> np.ndarray:
        return self.doc[k - 1 :] == self.doc[: len(self.doc) - k + 1] if len(self.doc) >= k else np.zeros(0, bool)


def sliding(values: np.ndarray, width: int, smallest: bool = True) -> np.ndarray:
    """Smallest (or largest) of each `width` consecutive values, by doubling."""
    pick = np.minimum if smallest else np.maximum
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = pick(out[: len(out) - (width - reach)], out[width - reach :])
    return out
