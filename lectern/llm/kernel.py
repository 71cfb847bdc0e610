"""Vectorised word kernels on UTF-8 bytes: spans, word hashes, window hashes.

A word hash is a polynomial over random byte weights modulo 2**64, read off a running sum, so
that one pass over the bytes serves every word. Such polynomials have texts of 1,024 letters and
more that collide for any base, so words of more than LONG bytes are hashed by BLAKE2b instead.
Window hashes repeat the polynomial over words, of which no window holds that many.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_SEGMENT = 1 << 19
#: Bytes of the longest word that the polynomial hashes.
LONG = 32


def _weights(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, 256, np.uint64, endpoint=False) | _U(1)


def _base(seed: int) -> int:
    return int(_weights(seed ^ 0x5EED)[0]) & ~7 | 5


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base, self.n = _base(seed), 0
        self.pow = self.inv = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("pow", self.base), ("inv", pow(self.base, -1, 1 << 64))):
                    x = np.full(self.n, b, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.pow, self.inv


_powers: dict[int, _Powers] = {}
_tables: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _powers:
        _powers[seed] = _Powers(seed)
    return _powers[seed].upto(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums and bit ranges of hashes behave."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true inside the given byte ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Words that white space ends: anything but U+0020 and U+0009 to U+000D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of letters and digits, everything outside ASCII counted as letters; A-Z count as folded.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the range of its words (n + 1 bounds)."""
    w = inside[data]
    full = offsets[:-1] < offsets[1:]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    lo, hi = offsets[:-1][full], offsets[1:][full] - 1
    s[lo] = w[lo]
    e[hi] = w[hi]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z count as a-z."""
    if (seed, fold) not in _tables:
        t = _weights(seed)
        if fold:
            t = t.copy()
            t[0x41:0x5B] = t[0x61:0x7B]
        _tables[seed, fold] = t
    table, out = _tables[seed, fold], np.empty(len(start), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _SEGMENT, "right")))
            a, b = int(start[lo]), int(end[hi - 1])
            p, inv = powers(seed, b - a + 1)
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[data[a:b]] * p[: b - a], out=run[1:])
            s = start[lo:hi] - a
            out[lo:hi] = (run[end[lo:hi] - a] - run[s]) * inv[s]
            lo = hi
        out = mix(out + (end - start).astype(np.uint64))
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        view, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        for k, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
            word = bytes(view[a:b])
            out[k] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8, key=key).digest(), "little")
    return out


def windows(hashes: np.ndarray, first: np.ndarray, size: np.ndarray | int, seed: int = 23) -> np.ndarray:
    """Hashes of the word windows that start at word `first` and hold `size` words."""
    p, inv = powers(seed, len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * p[: len(hashes)], out=run[1:])
        return mix((run[first + size] - run[first]) * inv[first] + _U(seed))


def positions(bounds: np.ndarray, size: int) -> np.ndarray:
    """Word indexes at which a window of `size` words fits into its row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ragged(bounds[:-1], counts)


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... counts[i] times, one row after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - start, counts)
