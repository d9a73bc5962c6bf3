import hashlib
import re
from statistics import mean

import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import order_minhash
from postlens.llm.queries import QUERIES


def edited(rows):
    """Edited texts by (id, text): distinct rows in order of falling id, then of row key."""
    def row(i, t):
        return hashlib.sha256(f"{chr(0) if i is None else i}\x1f{t}".encode()).digest()[:16]

    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), row(*r)))
    found = {}
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        found[i, t] = t[: len(t) - half] + following[:half]
    return found


def test_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op4_order_minhash"](spark, sf_dir).collect()}
    texts = [(i, t or "") for i, t in texts]
    other = edited(texts)
    prints = {}
    for i, t in texts:
        r = rows.pop(i)
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(other[i, t].encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        prints.setdefault(other[i, t], r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert not rows


def chained(*parts):
    """Spark's 64-bit hash of strings, of 64-bit numbers, and of a last 32-bit one as bytes."""
    seed = 42
    for part in parts:
        data = part.encode() if isinstance(part, str) else part if isinstance(part, bytes) else part.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_fingerprint(text):
    words = [chained(w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    kmers, seen = [], {}
    for i in range(len(words)):
        kmer = chained(*words[i : i + 3])
        n = seen[kmer] = seen.get(kmer, -1) + 1
        kmers.append((chained(kmer, n.to_bytes(4, "little")) if n else kmer, i))
    ring = sorted(kmers)
    found = []
    for b in range(-32, 32):
        if not ring:
            found.append(0)
            continue
        start = next((p for p, (h, _) in enumerate(ring) if h >> 58 >= b), 0)
        pair = sorted({ring[start], ring[(start + 1) % len(ring)]}, key=lambda x: x[1])
        number = chained(*(h for h, _ in pair)) % (2**32 - 1) - 2**31 + 1
        found.append(number or 2**31 - 1)
    return found


def test_whole_fingerprints(spark, documents, texts, odd):
    rows = [t for _, t in texts] + [r["text"] for r in odd.collect()] + ["a", "a b", "a a a a", "x y x y x y z"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    for r in order_minhash.with_fingerprint(docs, "text", "f").collect():
        assert r["f"] == brute_fingerprint(r["text"])


@pytest.mark.parametrize("size", [60, 200, 600])
def test_order_counts_alike_in_short_and_long_texts(spark, size):
    """Halves change places: k-mers stay, the order of about half of the pairs turns."""
    pairs = []
    for n in range(30):
        words = [f"w{n}x{i}" for i in range(size)]
        pairs.append((" ".join(words), " ".join(words[size // 2 :] + words[: size // 2])))
    found = mean(likeness(spark, pairs))
    print(size, found)
    assert 0.35 < found < 0.55


def likeness(spark, pairs):
    docs = spark.createDataFrame(pairs, "a string, b string")
    docs = order_minhash.with_fingerprint(docs, "a", "fa")
    docs = order_minhash.with_fingerprint(docs, "b", "fb")
    return [r[0] for r in docs.select(order_minhash.likeness(F.col("fa"), F.col("fb"))).collect()]


def test_likeness_follows_edits_and_order(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(1000)]
    text = " ".join(words)
    little = " ".join([*words[:500], "new", *words[501:]])
    much = " ".join([w if i % 5 else f"x{i}" for i, w in enumerate(words)])
    swapped = " ".join(words[500:] + words[:500])
    repeated = " ".join(words[:100] * 10)
    same, one, many, turned, _ = likeness(
        spark, [(text, text), (text, little), (text, much), (text, swapped), (repeated, text)]
    )
    assert same == 1 and one > 0.9 and many < 0.4
    # The k-mers are nearly the same, only the order of the halves differs.
    assert turned < 0.75
    assert mean([one, turned, many]) < same


def test_repeats_are_numbered(spark):
    once, twice, thrice = "a b c d e f", "a b c d e f " * 2, "a b c d e f " * 3
    pairs = [(once, twice), (twice, thrice), (twice, twice)]
    found = likeness(spark, pairs)
    assert found[0] < 1 and found[1] < 1 and found[2] == 1


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    other = edited(rows)
    clash = odd.withColumnRenamed("source", "row").withColumnRenamed("score", "fingerprint")
    found = order_minhash.compare_edited(clash).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in found) == sorted(
        (str(i), len(t), other[i, t]) for i, t in rows
    )
    empty = next(r for r in found if r["doc_id"] == 7)
    assert set(empty["fingerprint"]) == {order_minhash.EMPTY}
    assert order_minhash.compare_edited(nothing).count() == 0
    single = order_minhash.compare_edited(odd.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
