import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from postlens.llm import perfect_hash, token_alignment
from postlens.llm.queries import BYTE_PAIRS, PIECES, QUERIES
from postlens.llm.token_units import CUT, byte_letters

PATHS = public_tokenizers.path(BYTE_PAIRS), public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def aligned(text, tokenizers):
    """Groups of ids of a whole text, byte by byte, or none."""
    if not text:
        return []
    a, b = tokenizers
    letters = byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    spelled_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    spelled_b = [
        bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in ids_b
    ]
    if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
        return []
    groups, i, j = [], 0, 0
    while i < len(ids_a):
        left, right, m, n = [ids_a[i]], [ids_b[j]], len(spelled_a[i]), len(spelled_b[j])
        i, j = i + 1, j + 1
        while m != n:
            if m < n:
                left.append(ids_a[i])
                m, i = m + len(spelled_a[i]), i + 1
            else:
                right.append(ids_b[j])
                n, j = n + len(spelled_b[j]), j + 1
        groups.append((left, right))
    return groups


def brute(rows, tokenizers):
    of = [(key, aligned(text, tokenizers)) for key, text in rows]
    links = [[(a, b) for left, right in groups for a in left for b in right] for _, groups in of]
    counts = Counter(pair for own in links for pair in set(own))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    found = []
    for (key, groups), own in zip(of, links, strict=True):
        printed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        found.append(
            (
                key,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                len(own),
                sum(counts[p] == best[p[0]] for p in own),
                sum(counts[p] for p in own),
                hashlib.sha256(printed.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(found, key=repr), counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, texts, sf_dir, tokenizers):
    found = QUERIES["op13_token_alignment"](spark, sf_dir)
    assert sorted(found.columns) == sorted(COLUMNS)
    rows = sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=repr)
    assert rows == brute(texts, tokenizers)[0]


def odd_texts():
    rng = random.Random(1)
    letters = ["a", "é", "Z", "9", "'s", "'", ".", "́", "漢", "\U0001f600", " ", " ", "　", "​"]
    letters += ["▁", "﻿", "\x1c", "\x85", "\n", "\t", "\r", "\x00", "<s>", "<0x41>", "<|endoftext|>", "ﬁ", "the"]
    texts = ["".join(rng.choice([" ", " ", *letters]) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(400)]
    texts += [None, "", " ", "  ", " a", "a ", "x" * 5000, "漢字" * 3000, "the cat " * 20_000, "a▁b c"]
    return [*texts, texts[0], texts[0]]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, monkeypatch, tokenizers, small):
    if small:
        for name, value in {"BUCKET": 200, "SLICE": 500, "HELD": 300, "ROWS": 50, "FAN_IN": 2, "STEP": 999}.items():
            monkeypatch.setattr(token_alignment, name, value)
    rows = [(i if i % 9 else None, text, "x", 1) for i, text in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, groups string, n_a int").repartition(5)
    found = token_alignment.align(docs, *PATHS).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = [(*(r[c] for c in COLUMNS[:-1]), digest(r["groups"])) for r in found]
    assert sorted(got, key=repr) == brute([r[:2] for r in rows], tokenizers)[0]


def test_pair_counts(spark, texts, tokenizers):
    rows = texts[:60] + [(1000, "a cat"), (1001, "a cat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabularies = token_alignment.Vocabularies(spark, *PATHS)
    index, _ = token_alignment.pair_index(docs, "text", vocabularies)
    found = {(r["a"], r["b"]): r["docs"] for r in token_alignment.pair_counts(index).collect()}
    assert found == brute(rows, tokenizers)[1]


def test_no_rows(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in token_alignment.align(nulls, *PATHS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))[:n]
        function = perfect_hash.PerfectHash(perfect_hash.build(keys))
        assert function.size == len(keys)
        assert np.array_equal(np.sort(function.indexes(keys)), np.arange(len(keys)))
        foreign = function.indexes(rng.integers(1 << 63, 1 << 64, 1000, np.uint64))
        assert foreign.max(initial=-1) < max(len(keys), 1)
    packed = np.arange(50_000, dtype=np.uint64) << np.uint64(32)
    assert np.array_equal(np.sort(perfect_hash.PerfectHash(perfect_hash.build(packed)).indexes(packed)), np.arange(50_000))


def test_places_to_cut():
    assert CUT.split("a b  c  d ▁ e\n f") == ["a", "b  c  d ▁ e\n f"]


def test_the_faster_encoder_gives_the_same_ids(texts, tokenizers):
    import json

    from postlens.llm.token_units import LATIN_PART, Tokenizers

    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        spec, model = a.read(), b.read()
    own = Tokenizers(spec, model)
    rng = random.Random(2)
    words = {" " + w for _, t in texts for w in (t or "").split(" ") if LATIN_PART.match(" " + w)}
    letters = ["\n", *(chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)))]
    words |= {" x" + "".join(rng.choices(letters, k=rng.randint(0, 30))) + "y" for _ in range(20_000)}
    assert all(LATIN_PART.match(w) for w in words)
    for word in words:
        assert own.fast.encode_ordinary(word) == own.a.encode(word, add_special_tokens=False).ids
    # A vocabulary with a token that its merges do not reach has no such encoder.
    other = json.loads(spec)
    merges = other["model"]["merges"]
    merges[-1] = merges[0] if isinstance(merges[0], str) else list(merges[0])
    assert Tokenizers(json.dumps(other), model).fast is None
