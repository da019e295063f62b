"""Vectorised tokenising and hashing of bytes and code points."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, np.uint64(base), np.uint64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``: differences of a polynomial prefix sum, rebased and mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    ink = np.empty(len(data) + 2, np.int8)
    ink[0] = ink[-1] = 0
    ink[1:-1] = ~_BLANK[data]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text with A-Z lower-cased.

    With fewer than n words the whole sequence is the one shingle; without words there is none.
    """
    data = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() changes A-Z only
    s, e = words(data)
    if not len(s):
        return np.zeros(0, np.uint64)
    w = run_hashes(data, s, e)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * _ODD + w[i : len(w) - k + 1 + i])
    return np.unique(h)
