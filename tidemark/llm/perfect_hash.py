"""Minimal perfect hash over 128-bit keys, built and probed with whole arrays.

Level by level every key that is alone in its slot gets that slot; keys that met go on to the
next level. The rank of a slot among all taken ones is the key's number, below the key count.
"""

from __future__ import annotations

import numpy as np

GAMMA, MOST_LEVELS = 2.0, 64


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64-bit values, another spread for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(high ^ mixed(low, level), level) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Hash of distinct keys, given as two arrays of unsigned 64-bit integers."""
        sizes: list[int] = []
        taken: list[np.ndarray] = []
        while len(high):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys repeat")
            size = -(-int(len(high) * GAMMA + 1) // 64) * 64
            at = slots(high, low, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            taken.append(alone)
            rest = ~alone[at]
            high, low = high[rest], low[rest]
        flat = np.concatenate(taken) if taken else np.zeros(0, bool)
        return cls(sizes, np.packbits(flat, bitorder="little").view("<u8"))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key; any number, or -1, for a key that was not there when it was built."""
        found = np.full(len(high), -1, np.int64)
        open_, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = base + slots(high[open_], low[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_, base = open_[~hit], base + size
        return found
