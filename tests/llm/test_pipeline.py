import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm import bpe, jaccard, mixing
from postlens.llm.queries import RANKS
from postlens.workspace import new_folder


@pytest.fixture(scope="module")
def steps(spark, documents, sf_dir):
    found, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "test-stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        found.append(docs)
    return found


def test_stages_return_documents(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(step.columns == steps[0].columns for step in steps[:-1])


def test_quality_keeps_trusted_documents(spark, steps, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    long = steps[0].where(F.size(F.split("text", " ")) > 60).join(labels, "doc_id")
    good, bad = long.where("quality = 1 AND toxic = 0"), long.where("quality = 0")
    kept = steps[1].select("doc_id")
    # A good document lost counts ten times a bad one kept, so a few bad ones pass.
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert bad.join(kept, "doc_id").count() <= 0.1 * bad.count()


def test_one_of_each_group(steps):
    classes = jaccard.near_duplicates(steps[1])
    kept = {r[0] for r in steps[2].select("doc_id").collect()}
    assert kept == {r[0] for r in classes.select("class_id").distinct().collect()}


def test_no_passage_is_left_twice(steps):
    rows = steps[3].select("doc_id", "text").collect()
    before = dict(steps[2].select("doc_id", "text").collect())
    assert {r["doc_id"] for r in rows} == before.keys()
    seen = {}
    for i, text in sorted(before.items()):
        data = text.encode()
        for p in range(len(data) - 49):
            seen.setdefault(data[p : p + 50], i)
    for i, text in rows:
        changed = any(seen[d[p : p + 50]] < i for d in [before[i].encode()] for p in range(len(d) - 49))
        assert (text != before[i]) == changed


def test_mix_and_tokens(steps):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    times = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in taken.items() if n}
    assert steps[5].count() == steps[4].count()
    assert steps[5].where("NOT round_trip OR n_tokens != size(ids)").count() == 0
    with open(public_tokenizers.path(RANKS), "rb") as file:
        table = bpe.parse_ranks(file.read())
    spelled = {rank: token for token, rank in table.items()}
    texts = dict(steps[4].select("doc_id", "text").collect())
    for row in steps[5].limit(50).collect():
        assert b"".join(spelled[i] for i in row["ids"]) == texts[row["doc_id"]].encode()


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    """Columns with the names of results, NULL and repeated keys, and marks of its own."""
    passage = " ".join(f"word{i} of{i % 7} a text" for i in range(60))
    mark = chr(0xFFFD)
    rows = [
        (1, passage + f" {mark}", "en", "s"), (1, passage + f" {mark}", "en", "s"), (None, passage, "en", None),
        (None, passage, "en", None), (2, "é" + passage[::-1], "de", "s"), (3, None, None, None), (4, "", "x", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = ["score", "kept", "base_failed", "_one", "_kept", "n_bytes", "id", "key", "run", "size", "copies", "hash"]
    docs = docs.withColumns({name: F.concat(F.lit(f"own {name} "), F.coalesce("doc_id", F.lit(0))) for name in extra})
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    texts = {row[1] for row in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        folder = new_folder(spark, "test-stage")
        stage(spark, docs, str(tmp_path)).write.parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        assert docs.columns == before.columns
        for row in docs.collect():
            assert all(row[name] == f"own {name} {row['doc_id'] or 0}" for name in extra)
            assert row["text"] in texts
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert left <= {(1, passage + f" {mark}"), (2, "é" + passage[::-1])}
    assert corpus_pipeline.byte_level_bpe(spark, docs, "").where("NOT round_trip").count() == 0


def test_nothing(spark, documents, sf_dir):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "test-empty")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    assert docs.count() == 0


def test_a_core_feeds_one_python_worker_at_a_time(spark, odd):
    """Encoder and decoder in one job kept two workers with a batch each for every core."""
    docs = odd.withColumns({"lang": F.lit("en"), "digest": F.lit("own")})
    found = corpus_pipeline.byte_level_bpe(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    rows = found.collect()
    assert len(rows) == odd.count() and all(row["round_trip"] for row in rows)
    with open(public_tokenizers.path(RANKS), "rb") as file:
        spelled = {rank: token for token, rank in bpe.parse_ranks(file.read()).items()}
    decoded = sorted(b"".join(spelled[i] for i in row["ids"]).decode() for row in rows)
    assert decoded == sorted(row["text"] or "" for row in odd.collect())
