import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import blocks, jaccard, shingles
from postlens.llm.graph import components
from postlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def grams(text, width=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def brute(rows, threshold=0.8):
    """`id: (class_id, copy_id, n_copies, n_links)` by comparing all pairs that share an n-gram."""
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    texts = list(by_text)
    sets = [grams(t) for t in texts]
    inverted, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            shared.update((j, k) for j in inverted[g])
            inverted[g].append(k)
    root, links = list(range(len(texts))), Counter()

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for (j, k), n in shared.items():
        if n >= threshold * (len(sets[j]) + len(sets[k]) - n):
            links[j] += 1
            links[k] += 1
            root[top(k)] = top(j)
    members = defaultdict(list)
    for k, t in enumerate(texts):
        members[top(k)] += by_text[t]
    return Counter(
        (i, least(members[top(k)]), least(by_text[t]), len(by_text[t]), links[k])
        for k, t in enumerate(texts)
        for i in by_text[t]
    )


def found(df, key="doc_id"):
    columns = [key, "class_id", "copy_id", "n_copies", "n_links"]
    return Counter(map(tuple, df.select(*columns).collect()))


def test_query(spark, sf_dir, texts):
    assert found(QUERIES["op7_ngram_jaccard_join"](spark, sf_dir)) == brute(texts)


@pytest.fixture(scope="module")
def family():
    """A group of near copies larger than a block, chains, and texts around the threshold."""
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    base = random.choices(words, k=200)
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(random.randint(0, 5)):
            text[random.randrange(len(text))] = random.choice(words)
        rows.append((i, " ".join(text)))
    chain = random.choices(words, k=120)
    for i in range(90, 130):
        chain[random.randrange(len(chain))] = random.choice(words)
        rows.append((i, "  ".join(chain)))
    rows += [(i, " ".join(random.choices(words, k=60))) for i in range(130, 160)]
    rows += [(i, rows[i - 160][1]) for i in range(160, 200)]
    return rows


def test_blocks_agree_with_all_pairs(spark, family, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 15)
    docs = spark.createDataFrame(family, "doc_id bigint, text string")
    assert found(jaccard.near_duplicates(docs)) == brute(family)


def test_one_of_each(spark, family):
    docs = spark.createDataFrame(family, "doc_id bigint, text string")
    kept = {r[0] for r in jaccard.one_of_each(docs).select("doc_id").collect()}
    assert kept == {c for _, c, *_ in brute(family)}


def test_one_of_each_whatever_the_keys(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (None, passage, "a"), (None, passage, "b"), (7, passage, "c"), (7, passage, "d"), (9, passage + " more", "e"),
        (1, "x y", "f"), (5, "x y", "g"), (5, "another text of its own", "h"), (5, "x y", "i"),
        (None, "only without a key", "j"), (None, "only without a key", "k"), (None, None, "l"), (3, "", "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string")
    docs = docs.withColumns({"key": F.create_map(F.lit("a"), F.lit(1)), "root": F.lit(1), "_key": F.lit("own")})
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert found == [
        (0, "only without a key"), (1, "x y"), (3, ""), (5, "another text of its own"), (7, passage)
    ]


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumnRenamed("source", "key").withColumnRenamed("score", "class_id")
    assert found(jaccard.near_duplicates(clash)) == brute(rows)
    assert jaccard.near_duplicates(nothing).count() == 0
    assert jaccard.one_of_each(nothing).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    expected = {str(class_id) for _, class_id, *_ in brute(rows)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(expected)


def test_bands_reach_the_recall():
    for threshold, recall, most in ((0.8, 0.9999, 192), (0.5, 0.99, 256), (0.95, 0.999, 64)):
        bands, rows = jaccard.choose_bands(threshold, recall, most)
        assert bands * rows <= most
        assert 1 - (1 - threshold**rows) ** bands >= recall
        more = jaccard.choose_bands(threshold, recall, most + bands + 200)
        assert more[1] >= rows
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.9999, 10)


def test_shingles_are_those_of_words():
    texts = ["a b c d e f", "", "x", "a b\tc\nd  e", " a b c d e ", "é ü", "a b c d e f"]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    hashes, counts = shingles.shingle_hashes(np.frombuffer(b"".join(data), np.uint8), ends, 5)
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    assert counts.tolist() == [len(grams(t)) for t in texts]
    assert (parts[0] == parts[6]).all() and parts[3] == parts[4] == parts[0][0]
    assert len(set(hashes.tolist())) == len(set().union(*map(grams, texts)))


def test_intersections():
    random.seed(9)
    sets = [np.unique(np.array(random.sample(range(60), random.randint(0, 40)), np.uint64)) for _ in range(40)]
    if not len(sets[0]):
        sets[0] = np.array([1], np.uint64)
    expected = [[len(set(a) & set(b)) for b in sets[20:]] for a in sets[:20]]
    assert blocks.intersections(sets[:20], sets[20:]).tolist() == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(edges, "a int, b int")).collect()
    expected = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert sorted(map(tuple, rows)) == sorted(expected.items())
