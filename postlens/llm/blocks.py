"""Comparison of all pairs of sets in one pair of blocks."""

from __future__ import annotations

import numpy as np

# Columns of the incidence matrix multiplied at a time.
COLUMNS = 8192

# Fewer sets than this are intersected pair by pair.
FEW = 12


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets of sorted numbers."""
    total = np.zeros((len(left), len(right)), np.float32)
    grams, where = np.unique(np.concatenate(left), return_inverse=True)
    rows = np.repeat(np.arange(len(left)), [len(s) for s in left])
    found = np.concatenate(right)
    columns = np.repeat(np.arange(len(right)), [len(s) for s in right])
    if not len(grams) or not len(found):
        return total
    place = np.searchsorted(grams, found)
    hit = (place < len(grams)) & (grams[np.minimum(place, len(grams) - 1)] == found)
    place, columns = place[hit], columns[hit]
    # Only n-grams that both sides have take part; they get consecutive numbers.
    used = np.unique(place)
    number = np.full(len(grams), -1)
    number[used] = np.arange(len(used))
    where, place = number[where], number[place]
    rows, where = rows[where >= 0], where[where >= 0]
    for begin in range(0, len(used), COLUMNS):
        width = min(COLUMNS, len(used) - begin)
        a = np.zeros((len(left), width), np.float32)
        b = np.zeros((len(right), width), np.float32)
        here = (where >= begin) & (where < begin + width)
        a[rows[here], where[here] - begin] = 1
        here = (place >= begin) & (place < begin + width)
        b[columns[here], place[here] - begin] = 1
        total += a @ b.T
    return total


def linked(
    low: int, high: int, rows: list[tuple[bytes, int, bytes]], threshold: float
) -> list[tuple]:
    """`key, links, other` for the members `key, block, grams` of the blocks `low` and `high`.

    Each member with links gets a row with their number. Each link of a spanning forest
    gets a row with `other` and no count. Repeated keys are one member.
    """
    members = list({row[0]: row for row in rows}.values())
    left = [m for m in members if m[1] == low]
    right = left if low == high else [m for m in members if m[1] == high]
    if not left or not right:
        return []
    sets = {m[0]: np.frombuffer(m[2], np.uint64) for m in members}
    a, b = [sets[m[0]] for m in left], [sets[m[0]] for m in right]
    if len(members) <= FEW:
        shared = np.array(
            [[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.float32
        ).reshape(len(a), len(b))
    else:
        shared = intersections(a, b)
    sizes_a = np.array([len(x) for x in a])[:, None]
    sizes_b = np.array([len(x) for x in b])[None, :]
    links = (shared > 0) & (shared >= threshold * (sizes_a + sizes_b - shared) - 1e-6)
    if left is right:
        np.fill_diagonal(links, False)
    counts: dict[bytes, int] = {}
    for m, n in zip(left, links.sum(axis=1).tolist(), strict=True):
        counts[m[0]] = counts.get(m[0], 0) + n
    if left is not right:
        for m, n in zip(right, links.sum(axis=0).tolist(), strict=True):
            counts[m[0]] = counts.get(m[0], 0) + n
    found = [(key, n, None) for key, n in counts.items() if n]
    pairs = np.triu(links) if left is right else links
    root = {m[0]: m[0] for m in members}

    def top(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(pairs)), strict=True):
        x, y = top(left[i][0]), top(right[j][0])
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((max(x, y), 0, min(x, y)))
    return found
