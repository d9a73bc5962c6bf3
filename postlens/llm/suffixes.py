"""Numpy and byte-string work of the suffix deduplication, on one run or range at a time.

Positions are chosen by content: of every `LENGTH`-byte window, the anchor is the 20-byte
string inside it with the least hash, the rightmost of equals. Windows in a row with the
same anchor form a segment. Equal windows have equal anchors wherever they lie, so only
segments with the same anchor string can share a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack, unpack_from

import numpy as np

from postlens.llm.shingles import mixed, numbers, steps

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1

# An anchor with more segments than this goes window by window, which spreads it out.
HOT = 4096

_TABLE = numbers(256, 21)
_STEP = numbers(1, 22)[0]
_WINDOW_FACTORS = numbers(LENGTH, 23)
_POSITION = np.uint64((1 << 31) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all `GRAM`-byte strings, by doubling their length."""
    one = _TABLE[data]
    cur, length = one, 1
    for bit in bin(GRAM)[3:]:
        n = len(cur) - length
        cur = cur[:n] * np.uint64(pow(int(_STEP), length, 1 << 64)) + cur[length:]
        length *= 2
        if bit == "1":
            n = len(cur) - 1
            cur = cur[:n] * _STEP + one[length : length + n]
            length += 1
    return mixed(cur)


def segments(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Segments of texts laid end to end: columns text, first window, windows, anchor, hash."""
    found = []
    lengths = np.diff(ends, prepend=0)
    for first, last in steps(lengths):
        begin, end = int(ends[first] - lengths[first]), int(ends[last - 1])
        if end - begin < LENGTH:
            continue
        part = data[begin:end]
        hashes = gram_hashes(part)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes & ~_POSITION) | (_POSITION - place)
        width = 1
        while width * 2 <= WINDOW:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = WINDOW - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        anchor = (_POSITION - (least & _POSITION)).astype(np.int64)
        start = np.arange(len(anchor))
        text = np.searchsorted(ends[first:last] - begin, start, side="right")
        inside = start + LENGTH <= (ends[first:last] - begin)[text]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        heads = np.flatnonzero(new & inside)
        if not len(heads):
            continue
        ids = np.cumsum(new & inside) - 1
        windows = np.bincount(ids[inside], minlength=len(heads))
        base = (ends[first:last] - lengths[first:last] - begin)[text[heads]]
        found.append(
            np.stack(
                [
                    text[heads] + first,
                    heads - base,
                    windows,
                    anchor[heads] - base,
                    # An anchor has the least hash of many, so that its hash lies near 0. Mixed
                    # once more, anchors are spread evenly over the ranges that are merged.
                    mixed(hashes[anchor[heads]]).view(np.int64),
                ]
            )
        )
    return np.concatenate(found, axis=1) if found else np.empty((5, 0), np.int64)


def anchor_counts(found: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a run, and marks: segments, with the top bit if of several ids."""
    hashes = found[4].view(np.uint64)
    order = np.lexsort((ids[found[0]], hashes))
    hashes, owner = hashes[order], ids[found[0]][order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else order
    if not len(heads):
        return hashes, np.empty(0, np.uint16)
    counts = np.diff(np.append(heads, len(hashes)))
    several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    marks = np.minimum(counts, 32767).astype(np.uint16) | (several.astype(np.uint16) << 15)
    return hashes[heads], marks


def repeated(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """`run, hashes, hot` of each run: its anchors that texts of several ids have."""
    runs = np.concatenate([np.full(len(h), i) for i, (_, h, _) in enumerate(parts)])
    hashes = np.concatenate([h for _, h, _ in parts])
    marks = np.concatenate([m for _, _, m in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, runs, marks = hashes[order], runs[order], marks[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else order
    if not len(heads):
        return []
    size = np.diff(np.append(heads, len(hashes)))
    several = (size > 1) | (np.maximum.reduceat(marks >> 15, heads) > 0)
    hot = np.add.reduceat((marks & 32767).astype(np.int64), heads) > HOT
    several, hot = np.repeat(several, size), np.repeat(hot & several, size)
    hashes, runs, hot = hashes[several], runs[several], hot[several]
    return [(parts[i][0], hashes[runs == i], hot[runs == i]) for i in np.unique(runs).tolist()]


def entries(
    data: bytes, ends: np.ndarray, found: np.ndarray, hot: np.ndarray
) -> Iterator[tuple[bytes, int, int]]:
    """`key, text, start` of the suffixes to sort.

    A key is the anchor's hash, the lengths of both sides, the suffix from the anchor to the
    end of the segment, and what precedes the anchor in it. Windows of hot anchors are
    suffixes of their own, keyed by their own hash.
    """
    begins = ends - np.diff(ends, prepend=0)
    keys = found[4].view(np.uint64).byteswap().tobytes()
    cool = np.flatnonzero(~hot)
    text, start, windows, anchor = found[:4, cool]
    base = begins[text]
    rows = zip(
        cool.tolist(),
        text.tolist(),
        start.tolist(),
        (base + start).tolist(),
        (base + anchor).tolist(),
        (base + start + windows + LENGTH - 1).tolist(),
        strict=True,
    )
    for i, t, s, low, middle, high in rows:
        sides = bytes((high - middle, middle - low))
        yield keys[8 * i : 8 * i + 8] + sides + data[middle:high] + data[low:middle], t, s
    warm = np.flatnonzero(hot)
    if len(warm):
        text, start, windows = found[0, warm], found[1, warm], found[2, warm]
        text = np.repeat(text, windows)
        first = np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(start, windows) + np.arange(len(text)) - first
        low = begins[text] + start
        buffer = np.frombuffer(data, np.uint8)
        own = np.zeros(len(low), np.uint64)
        for j in range(LENGTH):
            own += _TABLE[buffer[low + j]] * _WINDOW_FACTORS[j]
        keys = mixed(own).byteswap().tobytes()
        sides = bytes((LENGTH, 0))
        for i, (t, s, at) in enumerate(zip(text.tolist(), start.tolist(), low.tolist(), strict=True)):
            yield keys[8 * i : 8 * i + 8] + sides + data[at : at + LENGTH], t, s


def sorted_run(
    found: Iterator[tuple[bytes, int, int]], ids: list[int]
) -> tuple[list[tuple[bytes, bytes]], list[tuple[int, int, int]]]:
    """Keys of a run in order, each once with the places of its least id; and spans removed.

    A further text of a run with a key that one of a smaller id has is covered there.
    """
    places: dict[bytes, list[tuple[int, int, int]]] = {}
    for key, text, start in found:
        places.setdefault(key, []).append((ids[text], text, start))
    run, spans = [], []
    for key in sorted(places):
        held = places[key]
        least = min(held)[0]
        span = key[8] + key[9]
        own = [(text, start) for owner, text, start in held if owner == least]
        spans += [(text, start, start + span) for owner, text, start in held if owner != least]
        flat = [x for place in own for x in place]
        run.append((key, pack(f"<q{len(flat)}i", least, *flat)))
    return run, spans


def front_coded(run: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted keys with payloads: how much a key shares with the one before, and the rest."""
    out, last = bytearray(), b""
    for key, payload in run:
        shared = common_prefix(last, key, 0)
        out += pack("<BBI", shared, len(key) - shared, len(payload))
        out += key[shared:]
        out += payload
        last = key
    return bytes(out)


def decoded(block: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    at, key = 0, b""
    while at < len(block):
        shared, rest, size = unpack_from("<BBI", block, at)
        at += 6
        key = key[:shared] + block[at : at + rest]
        at += rest
        yield shared, key, block[at : at + size]
        at += size


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two keys that agree up to `at`."""
    most = min(len(a), len(b))
    while at < most and a[at] == b[at]:
        if a[at : at + 16] == b[at : at + 16] and at + 16 <= most:
            at += 16
        else:
            at += 1
    return at


def merged(blocks: list[bytes]) -> Iterator[tuple[int, bytes, int, bytes]]:
    """`shared, key, block, payload` of sorted front-coded blocks, in order.

    A loser tree in which every loser knows how long a prefix it shares with the key that
    beat it, as the front coding tells for a block's next key. Of two keys, the one that
    shares more with the last winner is less; only if both share the same are bytes
    compared, from there on. `shared` is what the key shares with the one before it.
    """
    streams = [decoded(block) for block in blocks]
    count = 1 << max(len(streams) - 1, 0).bit_length()
    keys: list[bytes] = [b""] * count
    loads: list[bytes] = [b""] * count
    shared = [-1] * count  # -1: at its end, after every key

    def advance(i: int) -> None:
        found = next(streams[i], None) if i < len(streams) else None
        if found is None:
            shared[i] = -1
        else:
            shared[i], keys[i], loads[i] = found

    losers = [0] * count
    for i in range(count):
        advance(i)

    def beats(i: int, j: int) -> bool:
        """Whether i precedes j; the loser's shared prefix becomes that with the winner."""
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        if shared[i] < 0:
            return True
        a, b = keys[i], keys[j]
        at = common_prefix(a, b, shared[i])
        first = a[at:] <= b[at:]
        shared[j if first else i] = at
        return first

    # Leaves are count..2*count-1; the first round goes up level by level.
    level = list(range(count))
    while len(level) > 1:
        above = []
        for node in range(0, len(level), 2):
            i, j = level[node], level[node + 1]
            win, lose = (i, j) if beats(i, j) else (j, i)
            losers[(len(level) + node) // 2] = lose
            above.append(win)
        level = above
    i = level[0]
    while shared[i] >= 0:
        yield shared[i], keys[i], i, loads[i]
        advance(i)
        node = (count + i) // 2
        while node:
            j = losers[node]
            mine, other = shared[i], shared[j]
            if other > mine or (other == mine and mine >= 0 and not beats(i, j)):
                losers[node], i = i, j
            node //= 2


def covered(blocks: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """`block, text, start, end` of strings in the blocks that a smaller id has as well."""
    group: list[tuple[bytes, int, bytes]] = []
    for shared, key, block, payload in merged(blocks):
        if shared < 8 and group:
            yield from _resolved(group)
            group = []
        group.append((key, block, payload))
    if group:
        yield from _resolved(group)


def _resolved(group: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """Spans of one anchor's suffixes: whole segments first, then windows of those left."""
    if len(group) < 2:
        return
    # Of each key its least id, and the blocks that have it with that id: rows of one id may
    # lie in several runs, and do not count against each other.
    first: dict[bytes, tuple[int, list[tuple[int, bytes]]]] = {}
    for key, block, payload in group:
        owner = unpack_from("<q", payload)[0]
        best = first.get(key)
        lost: list[tuple[int, bytes]] = []
        if best is None:
            first[key] = owner, [(block, payload)]
        elif owner < best[0]:
            first[key], lost = (owner, [(block, payload)]), best[1]
        elif owner == best[0]:
            best[1].append((block, payload))
        else:
            lost = [(block, payload)]
        for lost_block, lost_payload in lost:
            for text, start in _places(lost_payload):
                yield lost_block, text, start, start + key[8] + key[9]
    left = sorted((owner, key) for key, (owner, _) in first.items())
    if len(left) < 2 or left[0][0] == left[-1][0]:
        return
    seen: dict[bytes, int] = {}
    for owner, key in left:
        split = 10 + key[8]
        string = key[split:] + key[10:split]
        hits = []
        for at in range(len(string) - LENGTH + 1):
            if seen.setdefault(string[at : at + LENGTH], owner) < owner:
                if hits and at <= hits[-1][1]:
                    hits[-1][1] = at + LENGTH
                else:
                    hits.append([at, at + LENGTH])
        for block, payload in first[key][1] if hits else ():
            for text, start in _places(payload):
                for low, high in hits:
                    yield block, text, start + low, start + high


def _places(payload: bytes) -> Iterator[tuple[int, int]]:
    flat = unpack_from(f"<{(len(payload) - 8) // 4}i", payload, 8)
    return zip(flat[::2], flat[1::2], strict=True)


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans `text, start, end` as maximal ones, in order of text and start."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    # Texts far apart on one line, so that a running maximum of ends can serve all at once.
    wide = np.int64(spans[:, 2].max()) + 1
    start, end = spans[:, 0] * wide + spans[:, 1], spans[:, 0] * wide + spans[:, 2]
    reach = np.maximum.accumulate(end)
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    last = np.append(heads[1:], len(spans)) - 1
    text = spans[heads, 0]
    return np.stack([text, spans[heads, 1], reach[last] - text * wide], axis=1)
