"""Token alignment of two tokenizers over the same bytes, by parts of a text.

A text is cut before single spaces between ordinary characters, where neither tokenizer can
join anything. A part met before is not tokenized again. Where tokens of both tokenizers end
at the same byte, a group of tokens ends; every token of one in a group is linked with every
token of the other.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

# Remembered parts, and links of them; a worker forgets all beyond either.
PARTS = 800_000
LINKS = 8_000_000

# Code points that are, to some library, white space, a mark of it or without width; other
# characters beside a space make it a place to cut at.
_UNSURE = [
    (0x00, 0x20),
    (0x7F, 0xA0),
    (0x1680, 0x1680),
    (0x180E, 0x180E),
    (0x2000, 0x206F),
    (0x2580, 0x259F),
    (0x3000, 0x3000),
    (0xFEFF, 0xFEFF),
]
_PLAIN = r"[^\s" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _UNSURE) + "]"
CUT = re.compile(f"(?<={_PLAIN}) (?={_PLAIN})")

# A part that such a cut may lie before and after.
PLAIN_PART = re.compile(f" {_PLAIN}(?:.*{_PLAIN})?\\Z", re.DOTALL)

# A part of characters whose kind no edition of the libraries' tables disputes.
LATIN_PART = re.compile(r" [!-~\xa1-\xac\xae-\u024f](?:[\n -~\xa1-\xac\xae-\u024f]*[!-~\xa1-\xac\xae-\u024f])?\Z")

# Fixed value: how a byte-level tokenizer cuts a text before it merges.
WORDS = (
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

# Fixed value: the mark for a space in pieces.
SPACE = chr(0x2581)


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A: a byte-level tokenizer from JSON. B: a piece model, which adds a space itself."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array([len(p) for p in self.b_bytes])
        self.shape = json.loads(a)
        shape = self.shape.get("pre_tokenizer") or {}
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        self.cuttable = (
            shape.get("type") == "ByteLevel"
            and shape.get("use_regex", True)
            and not any(inside.search(self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        )
        self.fast = self.ranked()

    def ranked(self):
        """A faster encoder of the same ids for A, or None if it could give others.

        It merges two tokens if together they are one, lowest id first, while A merges listed
        pairs, first ones first. These agree if ids follow the list, and if every token, cut
        out of its surroundings, is put together again by A: what stands for its bytes before
        its last merge is then always the listed pair.
        """
        import tiktoken

        model = self.shape.get("model", {})
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        vocabulary, letters = model.get("vocab", {}), byte_letters()
        first = len(letters)
        in_order = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges"))
            and self.shape.get("normalizer") is None
            and sorted(vocabulary.get(c, -1) for c in letters) == list(range(first))
            and all(vocabulary.get(x + y) == first + i for i, (x, y) in enumerate(merges))
            and len(vocabulary) == first + len(merges)
        )
        if not (in_order and self.cuttable):
            return None
        bare = self.bare()
        if any(e.ids != [i] for i, e in zip(vocabulary.values(), bare.encode_batch_fast(list(vocabulary)), strict=True)):
            return None
        ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def bare(self):
        """A without its cutting and its byte letters: merges of given letters only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.shape | {"pre_tokenizer": None, "added_tokens": []}))

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both for a text that begins with a space."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])

    @staticmethod
    def spelled(ids: list[int], of) -> bytes:
        return b"".join(map(of.__getitem__, ids))

    def parts(self, text: str) -> list[str]:
        """Parts of a space and the text, each with its space at the front."""
        found = CUT.split(text) if self.cuttable else [text]
        return [" " + part for part in found]


class Units:
    """What is known of parts seen so far, by number.

    `printing` keeps the printed groups of parts, otherwise their links are kept.
    """

    def __init__(self, tokenizers: Tokenizers, printing: bool) -> None:
        self.tokenizers, self.printing = tokenizers, printing
        self.clear()

    def clear(self) -> None:
        self.generation = object()
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # Per part: right or not, tokens of A and B, groups, links, and where links begin.
        self.rows = np.zeros((6, 1024), np.int64)
        self.links = np.zeros(4096, np.uint64)
        self.linked = 0

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the parts of each text; what is new is tokenized."""
        if len(self.number) > PARTS or self.linked > LINKS:
            self.clear()
        cut = [self.tokenizers.parts(text) for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.number)
        if new:
            self._learn(list(new))
        return [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) for parts in cut]

    def links_of(self, parts: np.ndarray) -> np.ndarray:
        """The links, A's id in the upper half, of the given parts one after the other."""
        counts = self.rows[4, parts]
        total = int(counts.sum())
        at = np.arange(total) + np.repeat(self.rows[5, parts] - (np.cumsum(counts) - counts), counts)
        return self.links[at]

    def _learn(self, new: list[str]) -> None:
        """Parts that may stand beside each other are tokenized in one text, others alone."""
        t = self.tokenizers
        latin = [u for u in new if t.fast and LATIN_PART.match(u)]
        done = set(latin)
        plain = [u for u in new if t.cuttable and u not in done and PLAIN_PART.match(u)]
        done.update(plain)
        alone = [u for u in new if u not in done]
        if latin:
            alone += self._together(latin, t.fast.encode_ordinary)
        if plain:
            alone += self._together(plain, lambda text: t.a.encode(text, add_special_tokens=False).ids)
        if alone:
            self._alone(alone)

    def _together(self, units: list[str], encode_a) -> list[str]:
        """Learn parts as one text; all are given back if any is not spelled right."""
        t = self.tokenizers
        data = [u.encode() for u in units]
        a, b = encode_a("".join(units)), t.b.encode([u[1:] for u in units], num_threads=1)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        flat_a = np.array(a, np.int64)
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        if not t.spelled(a, t.a_bytes) == t.spelled(flat_b.tolist(), t.b_bytes) == b"".join(data):
            return units
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        end_a, end_b = np.cumsum(t.a_sizes[flat_a]), np.cumsum(t.b_sizes[flat_b])
        n_a = np.diff(np.searchsorted(end_a, ends, "right"), prepend=0)
        if not (end_a[np.cumsum(n_a) - 1] == ends).all() or not (end_b[np.cumsum(n_b) - 1] == ends).all():
            return units
        self._add(units, np.ones(len(units), np.int64), flat_a, flat_b, n_a, n_b)
        return []

    def _alone(self, units: list[str]) -> None:
        t = self.tokenizers
        a, b, right = [], [], []
        for unit in units:
            ids_a, ids_b = t.encoded(unit)
            same = t.spelled(ids_a, t.a_bytes) == unit.encode() == t.spelled(ids_b, t.b_bytes)
            right.append(same)
            a.append(ids_a if same else [])
            b.append(ids_b if same else [])
        n_a, n_b = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
        flat_a = np.fromiter(chain.from_iterable(a), np.int64, n_a.sum())
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, n_b.sum())
        self._add(units, np.array(right, np.int64), flat_a, flat_b, n_a, n_b)

    def _add(self, units: list[str], right, flat_a, flat_b, n_a, n_b) -> None:
        """Align the tokens of some parts, which are given one after the other."""
        t = self.tokenizers
        end_a, end_b = np.cumsum(t.a_sizes[flat_a]), np.cumsum(t.b_sizes[flat_b])
        place = np.searchsorted(end_b, end_a)
        both = end_b[np.minimum(place, len(end_b) - 1)] == end_a if len(end_b) else np.zeros(0, bool)
        ends = end_a[both]
        # A token's group is the number of ends before its own end.
        of_a = np.cumsum(both) - both
        of_b = np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        first_b = np.cumsum(in_b) - in_b
        times = in_b[of_a]
        other = np.arange(int(times.sum())) + np.repeat(first_b[of_a] - (np.cumsum(times) - times), times)
        links = (np.repeat(flat_a, times).astype(np.uint64) << np.uint64(32)) | flat_b[other].astype(np.uint64)
        # Sums over the tokens of a part, from running totals.
        token_ends = np.cumsum(n_a)
        through = np.concatenate([[0], np.cumsum(times)])[token_ends]
        groups_through = np.concatenate([[0], of_a + 1])[token_ends]
        n_links, n_groups = np.diff(through, prepend=0), np.diff(groups_through, prepend=0)
        first = len(self.number)
        while first + len(units) > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
        while self.linked + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        here = slice(first, first + len(units))
        self.rows[:, here] = right, n_a, n_b, n_groups, n_links, self.linked + through - n_links
        self.links[self.linked : self.linked + len(links)] = links
        self.linked += len(links)
        if self.printing:
            self.groups += _printed(flat_a, flat_b, in_a, in_b, n_groups)
        self.number.update(zip(units, range(first, first + len(units)), strict=True))


def _printed(flat_a, flat_b, in_a, in_b, n_groups) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for every part."""
    a, b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    groups = [f"{a[i]}|{b[j]}" for i, j in zip(first_a.tolist(), first_b.tolist(), strict=True)]
    for g in np.flatnonzero((in_a > 1) | (in_b > 1)).tolist():
        i, j = first_a[g], first_b[g]
        groups[g] = f"{','.join(a[i : i + in_a[g]])}|{','.join(b[j : j + in_b[g]])}"
    ends = np.cumsum(n_groups)
    return [";".join(groups[i:j]) for i, j in zip((ends - n_groups).tolist(), ends.tolist(), strict=True)]
