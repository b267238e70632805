"""Words, lines and n-grams of many UTF-8 texts at once, as numpy arrays.

A block of texts is one byte array with offsets. Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D, so they never break a UTF-8 sequence. Strings are identified by
64-bit fingerprints: two polynomials of random byte values modulo the prime 2**31 - 1, each in
a random base, taken from prefix sums, then mixed with the length. (A polynomial modulo a power
of two would give some strings the same value in every base.)
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PRIME = (1 << 31) - 1
BASES = tuple(int(x) for x in np.random.Generator(np.random.PCG64(20250101)).integers(1 << 20, PRIME - 1, 2))
VALUES = np.random.Generator(np.random.PCG64(20250103)).integers(1, PRIME, (2, 256), dtype=np.uint64)
GRAM = np.random.Generator(np.random.PCG64(20250102)).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a base modulo the prime."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = reduced(out[:more] * np.uint64(pow(base, done, PRIME)))
        done += more
    return out


@lru_cache(maxsize=1)
def _block_powers(size: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    return tuple((powers(b, size).astype(np.uint32), powers(pow(b, -1, PRIME), size).astype(np.uint32)) for b in BASES)


# Longer texts make tables of their own, which go when they are done.
KEPT_POWERS = 1 << 21


class Fingerprints:
    """Fingerprints of any spans of a block."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        size = 1 << max(12, n.bit_length())
        tables = _block_powers(size) if size <= KEPT_POWERS else _block_powers.__wrapped__(size)
        self.parts = []
        for values, (up, down) in zip(VALUES, tables, strict=True):
            # Sums of fewer than 2**32 values below 2**31 fit.
            sums = np.zeros(n, np.uint64)
            np.cumsum(reduced(values[data] * up[: n - 1]), out=sums[1:])
            self.parts.append((sums, down))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = (reduced(reduced(sums[ends] - sums[starts]) * down[starts]) for sums, down in self.parts)
        return mixed((low | high << np.uint64(31)) + (ends - starts).astype(np.uint64) * GRAM[15])


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the text each belongs to."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, owners(offsets, starts)


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def windows(hashes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every run of ``size`` words within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(texts[:n] == texts[size - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total += hashes[first + k] * GRAM[k]
    return first, mixed(total)


def per_text(texts: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, for each of n texts."""
    if weights is None:
        return np.bincount(texts, minlength=n).astype(np.int64)
    return np.bincount(texts, weights=weights, minlength=n)


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point."""
    return (data & 0xC0) != 0x80
