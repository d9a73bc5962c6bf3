"""Hashes of word n-grams of many texts at once, in numpy arrays."""

from __future__ import annotations

import numpy as np

# Text bytes hashed at a time, except for single longer texts.
STEP = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """`count` fixed odd 64-bit numbers; more of them begin with the same ones."""
    base = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(base + np.uint64(seed)) | np.uint64(1)


_BYTES = numbers(256, 1)
_places = numbers(4096, 2)


def place_numbers(count: int) -> np.ndarray:
    global _places
    if count > len(_places):
        _places = numbers(1 << (count - 1).bit_length(), 2)
    return _places


def steps(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about `STEP` bytes each, whole texts only."""
    found, first, held = [], 0, 0
    for i, length in enumerate(lengths.tolist()):
        if held and held + length > STEP:
            found.append((first, i))
            first, held = i, 0
        held += length
    if len(lengths):
        found.append((first, len(lengths)))
    return found


def shingle_hashes(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word windows, and how many each text has.

    `data` holds the bytes of the texts one after the other, `ends` where each ends. A
    text of fewer words has one window of all of them, and one without words has none.
    """
    n = len(ends)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    lengths = np.diff(ends, prepend=0)
    first = (ends - lengths)[lengths > 0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum((inside & ~before)[at]) - 1
    place = at - starts[word]
    value = _BYTES[data[at]] * place_numbers(int(place.max()) + 1)[place]
    hashes = mixed(np.add.reduceat(value, np.flatnonzero(place == 0)))
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    factors = numbers(width + 1, 3)
    windows = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for j in range(width):
        windows += hashes[j : j + len(windows)] * factors[j]
    found = np.maximum(counts - width + 1, 0)
    word_ends = np.cumsum(counts)
    keep = np.arange(len(windows)) <= np.repeat(word_ends, counts)[: len(windows)] - width
    windows = mixed(windows[keep])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for i in short.tolist():
            own = hashes[word_ends[i] - counts[i] : word_ends[i]]
            extra.append((own * factors[1 : len(own) + 1]).sum(dtype=np.uint64) + np.uint64(len(own)))
        places = np.cumsum(found)[short]
        windows = np.insert(windows, places, mixed(np.array(extra, np.uint64)))
        found[short] = 1
    return windows, found
