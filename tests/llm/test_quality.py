import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shape(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    chars = sum(map(len, words))
    return n, chars, sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def xx(data, seed=42):
    """Spark's 64-bit hash of a string, or of a number given as one."""
    data = data.encode() if isinstance(data, str) else (data % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def grams(text):
    one = [xx(word) for word in WORD.findall(text or "")]
    two = [xx(h) if i + 1 == len(one) else xx(one[i + 1], xx(h)) for i, h in enumerate(one)]
    return one + two


def brute_scores(rows, trusted, rejected):
    """Score of every text, and the threshold, by the definition."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    own = {t: Counter(grams(t)) for t in {t or "" for i, t in rows if i in trusted}}
    distinct = len(set().union(*own.values())) if own else 0
    buckets = max(1024, 1 << max(0, 8 * distinct - 1).bit_length())
    at = lambda h: signed(h) % buckets
    own = {t: Counter(at(h) for h in found.elements()) for t, found in own.items()}
    trust, raw = sum(own.values(), Counter()), Counter()
    for _, text in rows:
        raw.update(map(at, grams(text)))
    raw_all, trust_all = sum(raw.values()), sum(trust.values())

    def ratio(n, total, bucket):
        share = n / total if total else 0.0
        x = 16 * math.log(0.5 + 0.5 * share * raw_all / raw[bucket])
        return min(127, math.copysign(math.floor(abs(x) + 0.5), x))

    scores = {}
    for text in {t or "" for _, t in rows}:
        left = own.get(text, Counter())
        size = trust_all - sum(left.values())
        found = [ratio(trust[b] - left[b], size, b) for b in map(at, grams(text))]
        scores[text] = sum(found) / len(found) / 16 if found else 0.0
    held = {True: {}, False: {}}
    for key, text in rows:
        if (key in trusted or key in rejected) and not shape(text)[5]:
            of = held[key in trusted]
            of[key] = min(of.get(key, math.inf), scores[text or ""])
    threshold = quality.best_threshold(list(held[True].values()), list(held[False].values()))
    return scores, threshold


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_shape_of_every_document(spark, documents, texts):
    found = quality.judge_quality(documents, None).select("doc_id", *COLUMNS).collect()
    expected = {i: shape(t) for i, t in texts}
    assert {r[0]: tuple(r[1:]) for r in found} == expected


def test_odd_rows(odd, nothing):
    extra = odd.withColumnsRenamed({"source": "n_words"}).withColumns(
        {name: F.lit("own") for name in ("_one", "_at", "_lines", "__kept", "digest", "gram", "_N_WORDS")}
    )
    found = quality.judge_quality(extra, None).collect()
    assert len(found) == odd.count()
    expected = {i: shape(t) for i, t in odd.select("doc_id", "text").collect()}
    assert all(tuple(r[c] for c in COLUMNS) == expected[r["doc_id"]] for r in found)
    assert all(r["_one"] == r["digest"] == "own" for r in found)
    kept = quality.judge_quality(extra, None, prefix="q_")
    assert kept.columns[: len(extra.columns)] == extra.columns
    assert {r["score"] for r in kept.collect()} == {r["score"] for r in odd.collect()}
    assert quality.judge_quality(nothing, None).count() == 0


def test_repeats_within_lines(spark):
    rows = ["a b c a b c", "a a a a", "x\nx\n\n\nx y\nx", "$$ ## a|b", " a b  c\ta\x0bb c d", "x x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    found = quality.judge_quality(docs, None).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == [shape(t) for t in rows]


LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("joined", [False, True])
def test_scores_of_odd_rows(spark, monkeypatch, odd, joined):
    if joined:
        monkeypatch.setattr(quality, "LOOKED_UP", 1)
        monkeypatch.setattr(quality, "fits_broadcast", lambda size: False)
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (4, 1, 0), (9, 0, 0), (11, 0, 1), (3, 1, 1), (None, 1, 0), (77, 1, 0), (6, 1, 0)], LABELS
    )
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    scores, threshold = brute_scores(rows, {1, 2, 4, 6}, {9, 11})
    model = quality.fit_model(odd, labels)
    assert model.threshold == threshold
    assert (model.table is None) == joined
    for r in quality.judge_quality(odd, model, prefix="q_").collect():
        assert r["q_score"] == pytest.approx(scores[r["text"] or ""], abs=1e-9)
        assert r["q_kept"] == (not shape(r["text"])[5] and r["q_score"] >= threshold)


def test_scores_of_documents(spark, sf_dir):
    folder = f"{sf_dir}/../sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    marks = labels.collect()
    trusted = {r["doc_id"] for r in marks if r["quality"] == 1 and not r["toxic"]}
    scores, threshold = brute_scores(rows, trusted, {r["doc_id"] for r in marks if r["quality"] == 0})
    model = quality.fit_model(docs, labels)
    assert model.threshold == pytest.approx(threshold, abs=1e-9)
    for r in quality.judge_quality(docs, model).collect():
        assert r["score"] == pytest.approx(scores[r["text"] or ""], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)


def test_without_labels_or_rows(spark, odd, nothing):
    none = spark.createDataFrame([], LABELS)
    model = quality.fit_model(odd, none)
    judged = quality.judge_quality(odd, model).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in judged)
    model = quality.fit_model(nothing, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS))
    assert quality.judge_quality(nothing, model).count() == 0
    assert quality.judge_quality(odd, model).count() == odd.count()


def test_trusted_sample_is_bounded(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 0), (1, 1, 0), (5, 1, 0)], LABELS)
    assert {r[0] for r in quality.trusted_ids(labels).collect()} == {1, 5}
    assert quality.trusted_ids(labels, most=1).count() == 1
    assert [r[0] for r in quality.rejected_ids(labels).collect()] == [3]


def test_plans_hold_no_table(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_model(documents, labels)
    kept = quality.judge_quality(documents, model).where("kept AND n_words > 60")
    assert len(kept._jdf.queryExecution().toString()) < 100_000
    assert len(quality._judged_texts(documents, model, "text")._jdf.queryExecution().toString()) < 100_000


def test_threshold_parts_the_scores():
    assert quality.best_threshold([1.0, 2.0], [-1.0, 0.0]) == 0.5
    assert quality.best_threshold([1.0, 2.0], []) == -math.inf
    assert quality.best_threshold([], [-1.0]) == -math.inf
    assert quality.best_threshold([0.0] * 99 + [5.0], [0.0, 0.0]) == 0.0
    assert 0 < quality.best_threshold([0.0] + [5.0] * 99, [0.0, 0.0]) < 5


@pytest.mark.parametrize("size, lost, kept", [("sf0.001", 0.05, 0.4), ("sf0.01", 0.02, 0.45), ("sf0.1", 0.01, 0.05)])
def test_labelled_rows_left_out_of_the_fit(spark, sf_dir, size, lost, kept):
    folder = f"{sf_dir}/../{size}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.fit_model(docs, labels.where(~left_out))
    judged = quality.judge_quality(docs, model).where("NOT base_failed").join(labels, "doc_id", "left")
    judged = judged.select("quality", "toxic", left_out.alias("out"), F.col("kept").cast("int").alias("kept")).collect()
    share = lambda rows: sum(rows) / len(rows)
    assert 1 - share([r["kept"] for r in judged if r["out"] and r["quality"] == 1 and r["toxic"] == 0]) <= lost
    assert share([r["kept"] for r in judged if r["out"] and r["quality"] == 0]) <= kept
    # Rows without a label are no worse than all labelled ones together.
    assert share([r["kept"] for r in judged if r["quality"] is None]) >= 0.85
