import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postlens.llm import list_ranking, prefix_trie
from postlens.llm.list_ranking import list_ranks
from postlens.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(conversations):
    """Trie rows by conversation id and turns `(role, text)`, with sums from all descendants."""
    members, ends = {}, {}
    for conv, turns in conversations.items():
        turns = tuple((r or "", t or "") for r, t in turns)
        ends.setdefault(turns, []).append(conv)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    least = lambda found: min((c for c in found if c is not None), default=None)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    rows = set()
    sums = {}
    for prefix in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(prefix[-1][1])) if prefix else 0
        below = [sums[p] for p in children.get(prefix, ())]
        leaves = sum(s[0] for s in below) or 1
        saved = sum(s[1] for s in below) + (len(members[prefix]) - 1) * words
        sums[prefix] = leaves, saved
        listed = ",".join(str(c) for c in sorted(c for c in ends.get(prefix, ()) if c is not None))
        rows.add(
            (
                least(members[prefix]),
                len(prefix),
                least(members[prefix[:-1]]) if prefix else None,
                len(members[prefix]),
                len(below),
                leaves,
                saved,
                hashlib.sha256(listed.encode()).hexdigest(),
            )
        )
    return rows


COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
]
SCHEMA = "conv_id bigint, turn int, role string, text string, node string"


def found_rows(found):
    rows = [tuple(r) for r in found.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed, base", [(1, 4), (2, 2048)])
def test_random_tries(spark, monkeypatch, seed, base):
    monkeypatch.setattr(prefix_trie, "list_ranks", lambda links: list_ranks(links, base))
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rng = random.Random(seed)
    conversations = {}
    for conv in range(160):
        length = rng.choice([0, 1, 2, 3, 6])
        conversations[conv] = [(rng.choice("ua"), rng.choice(["x", "x y", "", None])) for _ in range(length)]
    for conv in range(200, 260):
        conversations[conv] = [("u", "a common start"), ("a", f"answer {conv % 50}")]
    conversations[None] = [("u", "a common start"), ("a", "of no id"), (None, None)]
    conversations[-5] = [("u", f"turn {i}") for i in range(300)]
    conversations[7] = conversations[-5][:150] + [("a", "another way")]
    rows = [(c, i, r, t, "x") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA)
    every = spark.createDataFrame([(c,) for c in conversations], "conv_id bigint")
    assert found_rows(prefix_trie.prefix_trie(turns, every)) == brute(conversations)


def test_order_of_turns_and_no_rows(spark):
    rows = [(1, 5, "u", "b", ""), (1, None, "u", "a", ""), (2, 0, "u", "a", ""), (2, 9, "u", "b", ""), (2, 9, "u", "b", "")]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    same = {1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "b"), ("u", "b")]}
    assert found_rows(found) == brute(same)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(4,)], "conv_id int"))
    assert found_rows(only) == brute({4: []})


def test_borrowed_starts(spark):
    rng = random.Random(3)
    rows = [(c, t, "u", f"{c}.{t}") for c in range(0, 90) if c != 40 for t in range(rng.choice([1, 2, 3, 7]))]
    rows += [(None, 0, "u", "n"), (None, 1, "a", "n2")]
    found = prefix_trie.with_borrowed_starts(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    own = {}
    for c, _, _, text in rows:
        own.setdefault(c, []).append(text)
    expected = set()
    for c, texts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        start = [] if c is None else own.get(c - c % 20, [])
        expected |= {(c, text) for text in start[:h] + texts[h:]}
    assert {(r["conv_id"], r["text"]) for r in found.collect()} == expected


def test_list_ranks(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for lane, length in enumerate([1, 2, 500, 37]):
        rank = 0
        ids = [b"%d-%d" % (lane, i) for i in range(length)]
        rng.shuffle(ids)
        for i, own in enumerate(ids):
            weight = rng.randrange(5)
            rows.append((own, ids[i + 1] if i + 1 < length else None, weight))
            expected[own] = rank
            rank += weight
    rng.shuffle(rows)
    links = spark.createDataFrame(rows, "id binary, next binary, weight bigint")
    for base in (8, 2048):
        assert {bytes(r["id"]): r["rank"] for r in list_ranks(links, base).collect()} == expected
    assert list_ranks(links.where("false")).count() == 0
    assert list_ranking.BASE == 2048


def test_query(spark, duck, sf_dir):
    found = QUERIES["op12_prefix_trie"](spark, sf_dir)
    cursor = duck.execute(ORACLE["op12_prefix_trie"])
    names = [c[0] for c in cursor.description]
    assert found_rows(found) == {tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()}
    assert sorted(names) == sorted(found.columns)
    assert found.agg(F.sum((F.col("n_children") == 0).cast("int"))).first()[0] == found.where("depth = 0").first()["n_leaves"]
