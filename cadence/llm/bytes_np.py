"""Vectorised word, line and window fingerprints over the byte buffer of many texts.

A word is a run of bytes other than space and \\t..\\r. Fingerprints are 64-bit
polynomial hashes over a random byte table (seeded, so equal on all machines),
taken from prefix sums: the hash of any byte range costs two lookups. Two different ranges of one
document agree with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

from .common import Text

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... (mod 2**64), kept and grown by doubling."""
    p = _POWERS.get(kind)
    if p is None or len(p) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        _POWERS[kind] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class RangeHash:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * _powers("inv", BASE_INV, n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= _powers("base", BASE, len(self.sums))[start]
        return mix(out)


class Words:
    """Word boundaries of a slice of texts: ``start``, ``end`` (bytes), ``doc``, and each text's first word ``at``."""

    def __init__(self, t: Text):
        data, off = t.data, t.offsets
        inside = ~IS_SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)  # a word starts or ends where this byte and the one before differ, or a text begins
        if n:
            edge[1:n] = inside[1:] != inside[:-1]
            edge[0] = edge[n] = True
        edge[off] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        if n:
            word = inside[start]
            start, end = start[word], end[word]
        self.start, self.end, self.inside = start, end, inside
        self.at = np.searchsorted(start, off)
        self.per_doc = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(t)), self.per_doc)


def per_doc_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word fingerprints (len(words) - k + 1 of them, also across texts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= STEP
        h += words[j : j + n]
    return mix(h)


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once; is it not the first of its value."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order[1:]] = same
    later[order[1:]] = same
    many[order[:-1]] |= same
    return many, later
