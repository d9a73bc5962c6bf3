"""Byte-level BPE token ids, in linear time and without a merge loop over the text.

A piece of text is read as Latin-1, one character per byte, so that an Aho-Corasick
automaton of all tokens finds the longest token at every byte. Starting with the longest,
tokens are laid side by side as long as each pair is one that merging would leave apart;
where no token fits, the last one is taken back. An end position that failed once fails
always, because merging has one result only, so no position is tried twice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import importable

# Pieces, pairs and tokens a worker remembers; it forgets all of them beyond that.
MEMO = 300_000

# Rows whose results a worker holds at a time.
ROWS = 500

# Texts longer than this are cut into pieces one by one.
LONG = 1_000_000

_models: dict[str, Model] = {}
_tables: dict[str, dict[int, bytes]] = {}


class Model:
    """Ranks of a vocabulary, and what has been found out about its tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.stable: dict[int, bool] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.pieces = Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """The ids by the definition: join the adjacent parts of lowest rank, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((f for f in found if f[0] is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[part] for part in parts]

    def is_stable(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token; some can never come out."""
        known = self.stable.get(token)
        if known is None:
            known = self.stable[token] = self.merged(self.bytes[token]) == [token]
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            known = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
            self.apart[left, right] = known
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            data = self.bytes[token]
            cuts = (self.ranks.get(data[:end]) for end in range(len(data) - 1, 0, -1))
            self.shorter[token] = next((cut for cut in cuts if cut is not None), None)
        return self.shorter[token]

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * len(data)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - len(self.bytes[token])] = token
        ids: list[int] = []
        failed: set[int] = set()
        at, token = 0, longest[0]
        while at < len(data):
            while token is not None:
                end = at + len(self.bytes[token])
                if (
                    end not in failed
                    and self.is_stable(token)
                    and (not ids or self.stay_apart(ids[-1], token))
                ):
                    break
                token = self.next_shorter(token)
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at] if at < len(data) else None
            elif ids:
                failed.add(at)
                last = ids.pop()
                at -= len(self.bytes[last])
                token = self.next_shorter(last)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return ids


class Pieces(dict):
    """Pieces of text seen before, as the bytes of their 32-bit ids."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        import numpy as np

        ids = np.array(self.model.encode(piece.encode()), dtype="<i4").tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank, a line each."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def model_of(content: bytes) -> Model:
    """The model of a rank file; a worker process builds it once."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _models:
        _models[name] = Model(parse_ranks(content))
    return _models[name]


def table_of(content: bytes) -> dict[int, bytes]:
    """The bytes of each id, which is all that decoding needs."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _tables:
        _tables[name] = {rank: token for token, rank in parse_ranks(content).items()}
    return _tables[name]


def parts_of(stream: Iterator) -> Iterator:
    """The batches of a stream in parts of few rows."""
    for batch in stream:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def splitter(pattern: str):
    """The pattern, with white space as Unicode defines it instead of as Python does."""
    import regex

    # The characters of the property White_Space.
    space = r"\t-\r \x85\xa0  -     　"
    inside = pattern.replace(r"[^\s", f"[^{space}")
    return regex.compile(inside.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def encode_text(text: str, pattern, pieces: Pieces) -> bytes:
    if len(text) <= LONG:
        return b"".join(map(pieces.__getitem__, pattern.findall(text)))
    found = bytearray()
    for match in pattern.finditer(text):
        found += pieces[match.group()]
    return bytes(found)


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (all others by default) and the token ids of every whole text.

    `ranks` is a path the driver reads; its contents go to the workers. `pattern` cuts a
    text into pieces that are encoded each on its own; it must not need flags. NULL and
    empty texts get an empty list. Each row stands alone: repeated rows, NULL keys and any
    other columns pass through, and an empty table gives an empty table.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    importable(spark)
    with open(ranks, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    keep = [c for c in docs.columns if c not in (text, ids)] if keep is None else keep
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    )
    work = docs.select(*keep, docs[text].alias("_text_to_encode"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pieces, cut = model_of(vocabulary.value).pieces, splitter(pattern)
        for batch in parts_of(stream):
            column = batch.column(len(keep))
            found = [
                encode_text(value.as_py(), cut, pieces) if value.is_valid else b"" for value in column
            ]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype("<i4")
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, ids])

    return work.mapInArrow(batches, schema)


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the bytes of the ids, which need not be whole characters.

    NULL lists stay NULL. Ids outside the vocabulary are an error. A column named `out`
    is replaced.
    """
    import pyarrow as pa

    spark = tokens.sparkSession
    importable(spark)
    with open(ranks, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    keep = [c for c in tokens.columns if c != out]
    at = keep.index(ids)
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = table_of(vocabulary.value)
        for batch in parts_of(stream):
            column = batch.column(at)
            found = [
                b"".join(map(table.__getitem__, np.asarray(value.values).tolist()))
                if value.is_valid
                else None
                for value in column
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], [*keep, out]
            )

    return tokens.select(*keep).mapInArrow(batches, schema)


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of the ids in decimal, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
