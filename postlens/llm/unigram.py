"""Token counts under a unigram vocabulary, by a trie of distinct pre-tokens.

A pre-token's best segmentation is found by forward scores: the best score of a prefix is
that of a shorter prefix plus the last piece's. Pre-tokens with a common prefix have the
same scores up to its end, so the distinct new ones of some texts are put in a trie, whose
nodes are scored level by level, each once and all of a level at a time. The nodes at which
pre-tokens end give their counts, which are remembered.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from postlens.llm.common import importable

SPACE = "▁"

# A word with the space before it, a space of its own, or a line end.
PRETOKEN = re.compile(r" ?[^ \n]+| |\n")

# Pre-tokens that a worker remembers; it forgets all of them beyond that.
KNOWN = 600_000

# Pre-tokens put in one trie.
TRIE = 50_000

# Longer pre-tokens are scored without the trie.
DEEP = 64

# Characters of the texts whose pre-tokens are looked up at a time, except for longer texts,
# which are cut into pre-tokens some at a time.
STEP = 1_000_000
PIECES_HELD = 100_000

# What the score of an unknown character lies below the worst piece.
UNKNOWN = 10.0


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces given in order of rank, by Zipf's law."""
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)}


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece file, best first; the driver reads it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
    ids = [i for i in range(model.get_piece_size()) if not special(i)]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return [model.id_to_piece(i) for i in ids]


class Counts(dict):
    """Token counts of pre-tokens that have been learnt; a missing one is learnt alone."""

    def __init__(self, scores: dict[str, float], known: int = KNOWN) -> None:
        self.scores = scores
        self.most = known
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.scored = 0
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {last: sorted(found, reverse=True) for last, found in lengths.items()}
        # Pieces by length: sorted hashes, scores and characters; longer ones than the trie is
        # deep cannot end in it.
        self.pieces = []
        for length in sorted({len(piece) for piece in scores if len(piece) <= DEEP}, reverse=True):
            pieces = [piece for piece in scores if len(piece) == length]
            chars = _codes(pieces, length)
            hashes = _hashes(chars)[:, -1]
            order = np.argsort(hashes)
            values = np.array([scores[piece] for piece in pieces])
            self.pieces.append((length, hashes[order], values[order], chars[order]))
        self.letters = np.sort(np.array([ord(piece) for piece in scores if len(piece) == 1], np.uint32))

    def __missing__(self, pretoken: str) -> int:
        self.learn([pretoken])
        return self[pretoken]

    def new(self, pretokens: Iterable[str]) -> list[str]:
        """Those that are not known, each once; what was known is forgotten if it is too much."""
        if len(self) > self.most:
            self.clear()
        return list(set(pretokens).difference(self))

    def learn(self, pretokens: list[str]) -> None:
        """Count the tokens of different pre-tokens that are not known yet."""
        words = sorted((p.replace(" ", SPACE), p) for p in pretokens)
        short = [pair for pair in words if len(pair[0]) <= DEEP]
        for first in range(0, len(short), TRIE):
            some = short[first : first + TRIE]
            found = self._trie_counts([word for word, _ in some])
            self.update(zip([p for _, p in some], found, strict=True))
        for word, pretoken in words:
            if len(word) > DEEP:
                self[pretoken] = self._walked(word)

    def _trie_counts(self, words: list[str]) -> list[int]:
        """Counts of sorted words. A node of the trie is the first word with its prefix."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        deepest = int(sizes.max(initial=0))
        chars = _codes(words, deepest)
        hashes = _hashes(chars)
        # The level down to which a word shares nodes with the one before it.
        same = np.zeros(len(words), np.int64)
        if len(words) > 1:
            equal = (chars[1:] == chars[:-1]) & (chars[1:] != 0)
            same[1:] = np.where(equal.all(axis=1), deepest, np.argmin(equal, axis=1))
        best = np.full((len(words), deepest + 1), -np.inf)
        best[:, 0] = 0.0
        count = np.zeros((len(words), deepest + 1), np.int64)
        rows = np.arange(len(words))
        for end in range(1, deepest + 1):
            here = rows[(same < end) & (sizes >= end)]
            self.scored += len(here)
            top, tokens = np.full(len(here), -np.inf), np.zeros(len(here), np.int64)
            for length, known, values, pieces in self.pieces:
                if length > end:
                    continue
                before = hashes[here, end - length - 1] * _POWERS[length] if length < end else np.uint64(0)
                own = hashes[here, end - 1] - before
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = np.flatnonzero(known[place] == own)
                if not len(hit):
                    continue
                row, piece = here[hit], place[hit]
                right = (chars[row, end - length : end] == pieces[piece]).all(axis=1)
                hit, row, piece = hit[right], row[right], piece[right]
                score = best[row, end - length] + values[piece]
                better = score > top[hit]
                hit, row = hit[better], row[better]
                top[hit], tokens[hit] = score[better], count[row, end - length] + 1
            char = chars[here, end - 1]
            place = np.searchsorted(self.letters, char)
            spelled = np.ones(len(here), bool)
            if len(self.letters):
                spelled = self.letters[np.minimum(place, len(self.letters) - 1)] != char
            score = best[here, end - 1] + self.unknown
            spelled &= score > top
            size = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
            top = np.where(spelled, score, top)
            tokens = np.where(spelled, count[here, end - 1] + size, tokens)
            # Words that share the node take its scores from the first of them.
            best[here, end], count[here, end] = top, tokens
            shared = rows[(same >= end) & (sizes >= end)]
            first = np.maximum.accumulate(np.where(same < end, rows, 0))[shared]
            best[shared, end], count[shared, end] = best[first, end], count[first, end]
        return count[rows, sizes].tolist()

    def _walked(self, word: str) -> int:
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            score, count = self.step(word, end, scores, counts)
            scores.append(score)
            counts.append(count)
        return counts[-1]

    def step(
        self, word: str, end: int, scores: list[float], counts: list[int]
    ) -> tuple[float, int]:
        """Best score and count of the first `end` characters, from those of shorter ones.

        Of equal scores the longest last piece wins. A character that is no piece is
        spelled in its UTF-8 bytes, one token each.
        """
        best, count, char = -math.inf, 0, word[end - 1]
        for length in self.lengths.get(char, ()):
            if length > end:
                continue
            piece = self.scores.get(word[end - length : end])
            if piece is not None and scores[end - length] + piece > best:
                best, count = scores[end - length] + piece, counts[end - length] + 1
        if char not in self.scores and scores[end - 1] + self.unknown > best:
            best = scores[end - 1] + self.unknown
            count = counts[end - 1] + len(char.encode())
        return best, count


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(DEEP, _BASE)]), dtype=np.uint64)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each, with zeros behind them; the words hold no U+0000."""
    if not words or not width:
        return np.zeros((len(words), width), np.uint32)
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the rows; that of a part follows from two of them."""
    found = np.zeros(chars.shape, np.uint64)
    last = np.zeros(len(chars), np.uint64)
    for at in range(chars.shape[1]):
        last = last * _BASE + chars[:, at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        found[:, at] = last
    return found


def count_text(text: str, counts: Counts) -> tuple[int, int]:
    """Pre-tokens and tokens of a text; those of a long one are never all held at once."""
    pretokens = tokens = 0
    matches = PRETOKEN.finditer(text)
    while found := [match.group() for match in islice(matches, PIECES_HELD)]:
        counts.learn(counts.new(found))
        pretokens += len(found)
        tokens += sum(map(counts.__getitem__, found))
    return pretokens, tokens


def count_texts(texts: list[str], counts: Counts) -> list[tuple[int, int]]:
    """The same for several texts, whose new pre-tokens are learnt together."""
    found, first = [], 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= STEP):
            held += len(texts[last])
            last += 1
        if held > STEP:
            found.append(count_text(texts[first], counts))
        else:
            cut = [PRETOKEN.findall(text) for text in texts[first:last]]
            counts.learn(counts.new(chain.from_iterable(cut)))
            found += [(len(own), sum(map(counts.__getitem__, own))) for own in cut]
        first = last
    return found


_counts: dict[str, Counts] = {}


def count_tokens(
    docs: DataFrame, scores: dict[str, float], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` (all others by default), `n_pretokens` and `n_tokens` of every text.

    The vocabulary, of a fixed size, is broadcast. NULL and empty texts count 0. Rows stand
    alone: repeated rows and NULL keys pass through, long texts are counted whole, and an
    empty table gives an empty table. Columns of `docs` named like the counts are replaced.
    """
    import pyarrow as pa

    spark: SparkSession = docs.sparkSession
    importable(spark)
    vocabulary, name = spark.sparkContext.broadcast(scores), uuid.uuid4().hex
    new = ("n_pretokens", "n_tokens")
    keep = [c for c in docs.columns if c not in (text, *new)] if keep is None else keep
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField(name, T.LongType()) for name in new]
    )

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts.get(name)
        if counts is None:
            _counts.clear()
            counts = _counts[name] = Counts(vocabulary.value)
        for batch in stream:
            found = count_texts([value.as_py() or "" for value in batch.column(len(keep))], counts)
            new_columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new_columns], [*keep, *new])

    return docs.select(*keep, docs[text].alias("_text_to_count")).mapInArrow(batches, schema)
