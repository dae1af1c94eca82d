"""Vectorised words, word hashes and word shingles over UTF-8 byte buffers.

A word is a maximal run of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: digits,
Latin letters and everything beyond ASCII. All functions work on many documents at once.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15 | 1)


def _table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            t[b] = b
        elif 65 <= b <= 90:
            t[b] = b + 32
    return t


#: Byte → its lower-cased byte, or 0 outside words.
LOWER = _table()
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, below exponent n."""
    if len(_powers[0]) < n:
        inverse = _U(pow(int(_PRIME), -1, 1 << 64))
        for k, base in enumerate((_PRIME, inverse)):
            p = np.full(max(n, 1 << 16), base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, 64-bit hash, start, end) of every word, in order; start and end count bytes of ``data``."""
    low = LOWER[data]
    inside = low != 0
    if not inside.any():
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, _U), e, e
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(data)]] = False
    first = inside & ~before
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(low * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, hashes, starts, ends


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, index of its first word) of all runs of ``size`` words; a shorter text is one shingle."""
    if not len(rows):
        return rows, hashes, rows
    factors = mix(np.arange(1, size + 1, dtype=_U) * _PRIME) | _U(1)
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    m = len(rows) - size + 1
    at = np.flatnonzero(rows[: max(m, 0)] == rows[size - 1 :]) if m > 0 else np.zeros(0, np.int64)
    value = np.zeros(len(at), _U)
    for j in range(size):
        value += hashes[at + j] * factors[j]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin, extra = firsts[short], np.zeros(len(short), _U)
        for j in range(size - 1):
            has = counts[short] > j
            extra[has] += hashes[begin[has] + j] * factors[j]
        at = np.concatenate((at, begin))
        value = np.concatenate((value, extra))
    return rows[at], mix(value), at


def text_keys(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """128-bit keys (n_rows, 2) of the word sequences; equal for texts of equal words."""
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:n_rows]
    place = (np.arange(len(rows)) - firsts[rows]).astype(_U) if len(rows) else np.zeros(0, _U)
    out = np.zeros((n_rows, 2), _U)
    has = counts > 0
    for k, salt in enumerate((0x51ED270B, 0xA3C59AC3)):
        part = mix(mix(place + _U(salt)) ^ hashes)
        if len(rows):
            out[has, k] = np.add.reduceat(part, firsts[has])
        out[:, k] = mix(out[:, k] ^ (counts.astype(_U) * _U(salt)))
    return out
