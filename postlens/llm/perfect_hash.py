"""Minimal perfect hashing of 64-bit keys, in numpy arrays.

Keys hash into a bit array twice their number; those that meet no other set their bit, the
others try the next, smaller array. The index of a key is the number of bits set before its
own, so n keys have the indexes 0 to n - 1. A foreign key gets some index or none, so what
is stored at an index must include its key.
"""

from __future__ import annotations

import numpy as np

from postlens.llm.shingles import mixed, numbers

ROOM = 2
LEVELS = 40

_FACTORS = numbers(LEVELS, 21)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys * _FACTORS[level] + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """The hash function of different keys, about four bits each, as bytes.

    Keys without a bit after all levels, which hardly occurs, are stored as they are.
    """
    sizes, levels = [], []
    left = keys.astype(np.uint64)
    while len(left) and len(sizes) < LEVELS:
        size = -(-max(64, ROOM * len(left)) // 8) * 8
        slots = _slots(left, len(sizes), size)
        alone = np.bincount(slots, minlength=size) == 1
        sizes.append(size)
        levels.append(np.packbits(alone).tobytes())
        left = left[~alone[slots]]
    head = np.array([len(sizes), *sizes, len(left)], np.int64).tobytes()
    return head + b"".join(levels) + np.sort(left).tobytes()


class PerfectHash:
    """A function made by `build`, ready to be asked."""

    def __init__(self, data: bytes) -> None:
        count = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, count + 2)
        self.sizes = head[1 : count + 1].tolist()
        self.bits, self.before, at, base = [], [], 8 * (count + 2), 0
        for size in self.sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool)
            self.bits.append(bits)
            self.before.append((np.cumsum(bits) - bits + base).astype(np.int32))
            at, base = at + size // 8, base + int(bits.sum())
        self.rest = np.frombuffer(data, np.uint64, int(head[-1]), at)
        self.first_rest = base
        self.size = base + len(self.rest)

    def indexes(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; -1 for some that were not among those of `build`."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            slots = _slots(keys[open_], level, size)
            hit = self.bits[level][slots]
            found[open_[hit]] = self.before[level][slots[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            place = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[place] == keys[open_]
            found[open_[same]] = self.first_rest + place[same]
        return found
