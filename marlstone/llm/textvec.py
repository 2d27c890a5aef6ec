"""Vectorised hashing of words and word windows over concatenated UTF-8 texts.

A word's hash is a polynomial in its bytes, modulo 2^64, taken from running sums, so
that no Python code runs per word; windows of words are hashed from the words' hashes
in the same way.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
#: Odd factors, so that they have inverses modulo 2^64.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One random 64-bit number for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]

#: Words are runs of bytes outside \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of ASCII letters and digits and of bytes from 0x80.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that are kept between calls, for each base; longer runs are made anew.
KEEP, STEP = 3 << 19, 1 << 18


def _run(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) and their inverses, modulo 2^64."""
    if n > KEEP:
        return _run(base, n), _run(pow(base, -1, 1 << 64), n)
    if base not in _KEPT or len(_KEPT[base][0]) < n:
        size = -(-max(n, 1) // STEP) * STEP
        _KEPT[base] = (_run(base, size), _run(pow(base, -1, 1 << 64), size))
    up, down = _KEPT[base]
    return up[:n], down[:n]


class Words(NamedTuple):
    """Words of several texts in a row: hash, bounds in the joined bytes, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # len(texts) + 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(texts: list[bytes], separators: np.ndarray = SPACE, values: np.ndarray = BYTE_VALUES) -> Words:
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.empty(len(a) + 1, bool)
    inside[0] = False
    np.logical_not(separators[a], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    up, down = powers(BYTE_BASE, len(a))
    sums = values[a]
    sums *= up
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], U(0))
    hashes = mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))
    return Words(hashes, starts, ends, bounds)


def windows(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of each n consecutive words, by first word; across texts too, see inside()."""
    if len(hashes) < n:
        return np.empty(0, U)
    up, down = powers(base, len(hashes))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes + U(base)) * up, dtype=U)])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def inside(words: Words, n: int) -> np.ndarray:
    """Which of the windows() lie within one text."""
    owner = words.owner()
    return owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.empty(0, bool)
