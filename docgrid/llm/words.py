"""Words of many texts at once, as arrays: where they are and a 64-bit hash of each.

A word's hash is a polynomial over a fixed table of random 64-bit values, one per byte, taken
modulo 2^64 from prefix sums. The same bytes give the same hash in every process.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)


def _table(space: bytes = b"", word_bytes: np.ndarray | None = None) -> np.ndarray:
    if word_bytes is not None:
        return word_bytes
    t = np.ones(256, bool)
    t[list(space)] = False
    return t


#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = _table(b" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache
def _values(lower: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=U, endpoint=False)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.concatenate([[U(1)], np.multiply.accumulate(np.full(size - 1, q, U))]) for q in (U(_Q), U(_QINV))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (in place)."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Words:
    """start, end: byte places in buf; hash: uint64 (unless `hashed` is false); doc: first word of each text, and the number of words at the end."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool, hashed: bool = True):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        n = len(texts)
        raw = texts.buffers()
        at = np.frombuffer(raw[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        size = int(at[-1] - at[0])
        self.buf = np.frombuffer(raw[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
        self.at = at - at[0]
        m = is_word[self.buf]
        edge = np.zeros(size + 1, bool)
        edge[self.at] = True
        begin = m.copy()
        begin[1:] &= ~m[:-1] | edge[1:-1]
        close = m.copy()
        close[:-1] &= ~m[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(close) + 1
        self.doc = np.searchsorted(self.start, self.at)
        if not hashed:
            return
        if not len(self.start):
            self.hash = np.zeros(0, U)
            return
        power, inverse = _power(size)
        sums = np.cumsum(_values(lower)[self.buf] * power[:size])
        h = sums[self.end - 1]
        first = self.start > 0
        h[first] -= sums[self.start[first] - 1]
        h *= inverse[self.start]
        h += (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93)
        self.hash = mix(h)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts())


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    c = U(0x9FB21C651E98DF25)
    for k in range(n):
        out *= c
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
