import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from postlens.llm import unigram
from postlens.llm.queries import PIECES, QUERIES


@pytest.fixture(scope="module")
def scores():
    return unigram.zipf_scores(unigram.read_pieces(public_tokenizers.path(PIECES)))


@pytest.fixture(scope="module")
def library(scores):
    spelled = [(f"<0x{i:02X}>", -1000.0) for i in range(256)]
    return Tokenizer(models.Unigram([("<unk>", -20.0), *scores.items(), *spelled], 0, True))


def test_query(spark, sf_dir, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    known = {}

    def tokens(pretoken):
        if pretoken not in known:
            known[pretoken] = len(library.encode(pretoken.replace(" ", unigram.SPACE)).ids)
        return known[pretoken]

    for i, text in texts:
        found = unigram.PRETOKEN.findall(text or "")
        assert "".join(found) == (text or "")
        assert (rows[i]["n_pretokens"], rows[i]["n_tokens"]) == (len(found), sum(map(tokens, found)))


def test_strange_and_long_pretokens(scores, library):
    random.seed(7)
    counts = unigram.Counts(scores, known=100)
    letters = [chr(c) for c in (*range(0x21, 0x250), *range(0x390, 0x500), *range(0x1F600, 0x1F640))]
    for _ in range(20):
        words = {"".join(random.choices(letters, k=random.choice([1, 3, 9, 63, 64, 65, 200]))) for _ in range(40)}
        words |= {word[:k] for word in words for k in (2, 5, 62)}
        counts.learn(counts.new(words))
        assert all(counts[word] == len(library.encode(word).ids) for word in words)


def test_the_trie_agrees_with_single_steps(scores):
    random.seed(8)
    plain = unigram.Counts(scores)
    pieces = random.sample(sorted(scores), 400) + ["é", "☃", "a", " ", "\t", "\x00", "\r"]
    words = {"".join(random.choices(pieces, k=random.randint(1, 8))).replace("\n", "")[:64] for _ in range(3000)}
    counts = unigram.Counts(scores)
    counts.learn(list(words))
    assert all(counts[w] == plain._walked(w.replace(" ", unigram.SPACE)) for w in words)


def test_prefixes_are_scored_once(scores):
    counts = unigram.Counts(scores)
    counts.learn(["stations", "station", "stationary", "stat"])
    assert counts.scored == len("stationary") + 1
    counts["stations"]
    assert counts.scored == len("stationary") + 1


def test_ties_prefer_the_longest_last_piece():
    counts = unigram.Counts({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0})
    assert counts["ab"] == 1 and counts["aba"] == 2 and counts["c"] == 1


def test_odd_rows(odd, nothing, scores):
    clash = odd.withColumnRenamed("source", "n_tokens")
    rows = unigram.count_tokens(clash, scores).collect()
    plain = unigram.Counts(scores)
    assert sorted((r["n_pretokens"], r["n_tokens"]) for r in rows) == sorted(
        unigram.count_text(r["text"] or "", plain) for r in odd.collect()
    )
    assert unigram.count_tokens(nothing, scores).count() == 0
