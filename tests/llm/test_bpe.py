import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from postlens.llm import bpe
from postlens.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return bpe.model_of(file.read())


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_query(spark, sf_dir, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for i, text in texts:
        ids = library.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_strange_texts(model, library):
    import numpy as np

    random.seed(5)
    letters = [chr(c) for c in (*range(0x250), *range(0x390, 0x500), *range(0x2000, 0x2070), *range(0x3000, 0x3100))]
    pattern = bpe.splitter(PATTERN)
    for _ in range(1500):
        kind, n = random.random(), random.randint(0, 60)
        if kind < 0.4:
            text = "".join(random.choices(letters, k=n))
        elif kind < 0.7:
            text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        else:
            text = random.choice("aeo-= \n0\x1c") * random.randint(1, 300)
        ids = np.frombuffer(bpe.encode_text(text, pattern, model.pieces), "<i4").tolist()
        assert ids == library.encode_ordinary(text)


def test_long_pieces_take_linear_time(model, library):
    piece = "ab" * 50_000
    assert model.encode(piece.encode()) == library.encode_ordinary(piece)


def test_vocabulary_with_tokens_that_never_come_out():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"bcd": 260}
    model = bpe.Model(ranks)
    library = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    random.seed(6)
    for _ in range(500):
        text = "".join(random.choices("abcd", k=random.randint(1, 14)))
        assert model.encode(text.encode()) == library.encode_ordinary(text)


def test_odd_rows(odd, nothing, library):
    clash = odd.withColumnRenamed("source", "ids").withColumnRenamed("score", "decoded")
    tokens = bpe.encode(clash, PATH, PATTERN)
    rows = bpe.decode(tokens, PATH).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == sorted(texts)
    assert sorted(map(tuple, (r["ids"] for r in rows))) == sorted(tuple(library.encode_ordinary(t)) for t in texts)
    assert bpe.decode(bpe.encode(nothing, PATH, PATTERN), PATH).count() == 0
