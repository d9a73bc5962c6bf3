import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from postlens.llm import suffix_dedup, suffixes
from postlens.llm.queries import QUERIES

L = suffixes.LENGTH


def brute(rows):
    """`id, n_bytes, n_removed, n_spans, kept` of every row; NULL ids come last."""
    rows = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - L + 1):
            first.setdefault(t[p : p + L], i)
    out = []
    for i, t in rows:
        marks = np.zeros(len(t) + 1, int)
        for p in range(len(t) - L + 1):
            if first[t[p : p + L]] < i:
                marks[p] += 1
                marks[p + L] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((None if i == float("inf") else i, len(t), int(gone.sum()), spans, kept))
    return Counter(out)


def found(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return Counter((*r[:4], bytes(r["kept"])) for r in rows)


def made_texts(n, seed):
    random.seed(seed)
    words = ["".join(random.choices("abcdefgé", k=random.randint(1, 6))) for _ in range(60)]
    base = [" ".join(random.choices(words, k=random.randint(0, 120))) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = random.random()
        if kind < 0.2:
            text = random.choice(base)
        elif kind < 0.75:
            text = random.choice(base)
            for _ in range(random.randint(1, 5)):
                at, edit = random.randint(0, len(text)), random.random()
                if edit < 0.4:
                    text = text[:at] + "é" + text[at + 1 :]
                elif edit < 0.7:
                    text = text[:at] + text[at + random.randint(1, 60) :]
                else:
                    text = text[:at] + random.choice(base)[: random.randint(0, 90)] + text[at:]
        else:
            text = random.choice("aé") * random.randint(0, 200)
        out.append(text)
    return out


def test_query(spark, sf_dir, texts):
    rows = QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()
    expected = {r[0]: (*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(texts)}
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == expected


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("run_bytes", [700, 1 << 23])
def test_made_texts(spark, seed, run_bytes):
    rows = [(i * 3 % 101 if i % 17 else None, t) for i, t in enumerate(made_texts(120, seed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(suffix_dedup.remove_repeats(docs, run_bytes=run_bytes)) == brute(rows)


def test_hot_anchors_go_window_by_window(monkeypatch):
    """The whole chain of `suffixes` on runs, with every shared anchor hot and with none."""
    for hot in (0, 10**9):
        monkeypatch.setattr(suffixes, "HOT", hot)
        for seed in range(5):
            docs = list(enumerate(t.encode() for t in made_texts(40, seed)))
            runs = [[d for d in docs if d[0] % 5 == r] for r in range(5)]
            made, parts = [], []
            for r, own in enumerate(runs):
                data = b"".join(t for _, t in own)
                ends = np.cumsum([len(t) for _, t in own], dtype=np.int64)
                segments = suffixes.segments(np.frombuffer(data, np.uint8), ends)
                ids = np.array([i for i, _ in own])
                made.append((data, ends, segments, ids))
                parts.append((r, *suffixes.anchor_counts(segments, ids)))
            shared = {r: (h, w) for r, h, w in suffixes.repeated(parts)}
            blocks, spans = [], [[] for _ in runs]
            for r, (data, ends, segments, ids) in enumerate(made):
                hashes, warm = shared.get(r, (np.empty(0, np.uint64), np.empty(0, bool)))
                segments = segments[:, np.isin(segments[4].view(np.uint64), hashes)]
                is_hot = np.isin(segments[4].view(np.uint64), hashes[warm])
                entries, own = suffixes.sorted_run(suffixes.entries(data, ends, segments, is_hot), ids.tolist())
                block = suffixes.front_coded(entries)
                assert [x[1:] for x in suffixes.decoded(block)] == entries
                blocks.append(block)
                spans[r] += own
            for block, *span in suffixes.covered(blocks):
                spans[block].append(tuple(span))
            result = []
            for r, own in enumerate(runs):
                joined = suffixes.joined_spans(np.array(spans[r], np.int64).reshape(-1, 3)).tolist()
                for at, (i, t) in enumerate(own):
                    gone = [(a, b) for k, a, b in joined if k == at]
                    kept, done = b"", 0
                    for a, b in gone:
                        kept, done = kept + t[done:a], b
                    result.append((i, len(t), sum(b - a for a, b in gone), len(gone), kept + t[done:]))
            assert Counter(result) == brute([(i, t.decode()) for i, t in docs])


def test_merge_gives_sorted_keys_and_their_common_prefixes():
    random.seed(10)
    for count in (0, 1, 2, 3, 7, 16):
        runs = []
        for _ in range(count):
            keys = {bytes(random.choices(b"ab", k=random.randint(1, 9))) for _ in range(random.randint(0, 30))}
            runs.append([(k, bytes([len(k)])) for k in sorted(keys)])
        out = list(suffixes.merged([suffixes.front_coded(r) for r in runs]))
        assert [k for _, k, _, _ in out] == sorted(k for r in runs for k, _ in r)
        last = b""
        for shared, key, _, load in out:
            assert load == bytes([len(key)])
            assert key[:shared] == last[:shared] and (key[: shared + 1] != last[: shared + 1] or key == last)
            last = key


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumnRenamed("source", "run").withColumnRenamed("score", "kept")
    assert found(suffix_dedup.remove_repeats(clash)) == brute(rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert sorted(str(r["source"]) for r in left.collect()) == sorted(str(r["source"]) for r in odd.collect())


def test_no_fragments_of_characters_are_left(spark):
    passage = "é" * 30
    mark, tail = chr(0xFFFD), "a" * 60
    rows = [
        (1, "x" + passage), (2, passage[:26] + "☃ rest"), (3, f"ok {mark} here"),
        (4, "é" + tail), (5, f"x{mark}y ũ" + tail), (6, "ã" + passage[:30] + mark),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert left[1] == "x" + passage and left[2] == "☃ rest" and left[3] == f"ok {mark} here"
    assert left[4] == "é" + tail and left[5] == f"x{mark}y " and left[6] == "ã" + mark


def test_one_key_over_many_runs(spark):
    """Rows of one key, and rows without one, lie in many runs and leave each other whole."""
    random.seed(12)
    texts = made_texts(500, 13)
    rows = [(7 if i % 2 else None, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(made_texts(60, 14))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(suffix_dedup.remove_repeats(docs, run_bytes=4_000)) == brute(rows)
    ids = docs.select("doc_id", suffix_dedup.text_key(docs["text"]).alias("key"))
    runs = ids.select("doc_id", suffix_dedup.run_of(ids["doc_id"], ids["key"], 16).alias("run")).distinct()
    assert runs.where("doc_id IS NULL").count() == 16


def test_columns_of_any_name_are_kept(spark):
    names = ["kept", "n_bytes", "n_removed", "n_spans", "id", "key", "run", "rest", "text_", "_0", "_id"]
    rows = [(i, "z" * 40 + "y" * 40, *(f"{n}{i}" for n in names)) for i in (1, 2)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    found = suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [rows[0], (2, "", *rows[1][2:])]
