"""A minimal perfect hash of 64-bit keys, in levels of bits, read and built by numpy.

Level i maps what is left to 1.5 times as many places; a place that one key alone
takes has its bit set, all others go on to the next level. A key's slot is the
rank of its bit over all levels. A key outside the set gets some slot or none:
the caller compares the key that is stored there.
"""

from __future__ import annotations

import numpy as np

LOAD = 1.5
#: Keys left after so many levels have equal hashes; two of 2**17 random ones meet with a probability below 1e-9.
LEVELS = 64
_ODD = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Bits of uint64 keys spread anew for each seed."""
    x = keys + np.uint64((seed + 1) * _ODD % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_one(key: int) -> int:
    """``mixed`` of one key with seed 0."""
    mask = (1 << 64) - 1
    x = (key + _ODD) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


class PerfectHash:
    """Slots 0 to size - 1 for the keys it was built on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._ranks, size = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self._ranks.append(size + np.cumsum(ones) - ones)
            size += int(ones.sum())
        self.size = size

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct uint64 keys; raises if some are equal."""
        levels = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            width = max(1, -(-int(len(keys) * LOAD) // 64))
            places = (mixed(keys, len(levels)) % np.uint64(64 * width)).astype(np.int64)
            taken = np.bincount(places, minlength=64 * width)
            levels.append(np.packbits(taken == 1, bitorder="little").view(np.uint64))
            keys = keys[taken[places] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or any slot, for keys outside the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (words, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            places = mixed(keys[open_], seed) % np.uint64(64 * len(words))
            at, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            here = (words[at] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[at] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = (ranks[at] + below)[here]
            open_ = open_[~here]
        return out

    def to_bytes(self) -> bytes:
        return np.concatenate([np.array([len(self.levels), *map(len, self.levels)], np.uint64), *self.levels]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        numbers = np.frombuffer(data, np.uint64)
        ends = np.cumsum([1 + int(numbers[0]), *numbers[1 : 1 + int(numbers[0])].astype(np.int64)])
        return cls([numbers[a:b] for a, b in zip(ends, ends[1:])])
