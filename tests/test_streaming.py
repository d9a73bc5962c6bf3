import json
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postlens.functions import tokens_nw
from postlens.operators import label_posts, label_report, label_tokens, prepare_lexicon
from postlens.plans import lake_report, score_lake, tokenize_lake
from postlens.sample_lexicon import sample_lines
from postlens.sources import infer_schema, read_lines, read_tokens, sample_file, token_rows
from postlens.streaming import read_labels, run_available, start_labels, stream_tokens

TIMEOUT = 120


@pytest.fixture
def landed(spark, documents, tmp_path):
    path = str(tmp_path / "landed")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text").alias("data")
    documents.select(post).repartition(3).write.json(path)
    return path


@pytest.fixture
def lexicon_file(tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("\n".join(sample_lines()))
    return str(path)


def tokenize(spark, landed, tmp_path, **options):
    stream = tokenize_lake(
        spark, landed, str(tmp_path / "tokens"), str(tmp_path / "ck"), available_now=True, **options
    )
    run_available(stream, TIMEOUT)
    return stream


def test_tokens_arrive_once_over_several_batches_and_restarts(spark, documents, landed, tmp_path):
    first = tokenize(spark, landed, tmp_path, max_files=1)
    assert sum(p["numInputRows"] > 0 for p in first.recentProgress) == 3
    tokenize(spark, landed, tmp_path, max_files=1)
    got = read_tokens(spark, str(tmp_path / "tokens"))
    expected = documents.select(
        F.col("doc_id").cast("string").alias("id"), tokens_nw(F.col("text")).alias("text")
    )
    assert got.count() == 1_000
    assert got.exceptAll(expected).isEmpty()


def test_lines_that_land_later_are_added(spark, landed, tmp_path):
    tokenize(spark, landed, tmp_path)
    late = {"data": {"id": "late", "text": "so good"}}
    (pathlib.Path(landed) / "late.json").write_text(json.dumps(late) + "\n")
    tokenize(spark, landed, tmp_path)
    tokens = read_tokens(spark, str(tmp_path / "tokens"))
    assert tokens.count() == 1_001
    assert tokens.filter("id = 'late'").first().text == ["so", "good"]


def test_stray_files_are_not_read(spark, landed, tmp_path):
    tokenize(spark, landed, tmp_path)
    folder = tmp_path / "tokens"
    one = next(folder.glob("part-*.parquet"))
    (folder / "part-stray.snappy.parquet").write_bytes(one.read_bytes())
    assert read_tokens(spark, str(folder)).count() == 1_000


LINES = ['{"data":{"id":"1","text":"so good"}}', "", "not json", '{"data":{"id":"2"}}', '{"e":1}']


def test_lines_that_are_no_posts(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(LINES) + "\n")
    lines = read_lines(spark, str(tmp_path))
    assert sorted(r.id for r in token_rows(lines).collect()) == ["1", "2"]
    kept = token_rows(lines, keep_corrupt=True).collect()
    assert sorted(r.id or "" for r in kept) == ["", "", "1", "2"]


def test_inferred_schema_is_reused(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"data":{"id":"1","text":"a","n":1}}\n')
    (tmp_path / "two.json").write_text('{"data":{"id":"2","text":"b"},"other":true}\n')
    schema = infer_schema(spark, str(tmp_path / "one.json"))
    assert schema["data"].dataType.fieldNames() == ["id", "n", "text"]
    lines = read_lines(spark, str(tmp_path), schema)
    assert lines.columns == ["data"] and lines.count() == 2


def test_the_sample_is_a_file_with_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"data":{"id":"1"}}\n')
    assert sample_file(spark, str(tmp_path)).endswith("/b.json")


def test_row_groups(spark, landed, tmp_path):
    def groups(folder):
        return sum(pq.ParquetFile(f).num_row_groups for f in folder.glob("part-*.parquet"))

    tokenize(spark, landed, tmp_path)
    (tmp_path / "small").mkdir()
    tokenize(spark, landed, tmp_path / "small", row_group_bytes=1024)
    assert groups(tmp_path / "small" / "tokens") > groups(tmp_path / "tokens")
    assert read_tokens(spark, str(tmp_path / "small" / "tokens")).count() == 1_000


def test_lake_report_equals_the_batch_report(spark, documents, lexicon, landed, lexicon_file, tmp_path):
    tokenize(spark, landed, tmp_path)
    for edges in ("clean", "as_reference"):
        lake = lake_report(spark, str(tmp_path / "tokens"), lexicon_file, edges).collect()
        posts = documents.withColumnRenamed("doc_id", "id")
        assert lake == label_report(label_posts(posts, lexicon, "nw", edges), "share").collect()
        assert [r.pct for r in lake] == sorted((r.pct for r in lake), reverse=True)


def test_streamed_labels(spark, documents, lexicon, landed, lexicon_file, tmp_path):
    tokenize(spark, landed, tmp_path, max_files=1)
    for _ in range(2):
        stream = score_lake(
            spark, str(tmp_path / "tokens"), lexicon_file, str(tmp_path / "labels"),
            str(tmp_path / "labels-ck"), available_now=True, max_files=1,
        )
        run_available(stream, TIMEOUT)
    assert len(list((tmp_path / "labels-ck" / "commits").glob("[0-9]*"))) > 1
    labels = read_labels(spark, str(tmp_path / "labels"))
    expected = label_posts(documents.withColumnRenamed("doc_id", "id"), lexicon, "nw")
    got = labels.select(F.col("id").cast("bigint"), "score", "label")
    assert got.count() == 1_000 and got.exceptAll(expected).isEmpty()


def score(spark, lexicon, tmp_path, plan, checkpoint="labels-ck", path="labels"):
    stream = start_labels(
        stream_tokens(spark, str(tmp_path / "tokens"), max_files=1), prepare_lexicon(lexicon, plan),
        str(tmp_path / path), str(tmp_path / checkpoint), available_now=True,
    )
    run_available(stream, TIMEOUT)


@pytest.mark.parametrize("plan", ["row", "broadcast"])
def test_a_repeated_batch_adds_nothing(spark, lexicon, landed, tmp_path, plan):
    """The last batch runs again under its number, as after a lost checkpoint commit."""
    tokenize(spark, landed, tmp_path, max_files=1)
    score(spark, lexicon, tmp_path, plan)
    commits = sorted((tmp_path / "labels-ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) > 1
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    score(spark, lexicon, tmp_path, plan)
    expected = label_tokens(read_tokens(spark, str(tmp_path / "tokens")), lexicon)
    got = read_labels(spark, str(tmp_path / "labels")).select("id", "score", "label")
    assert got.count() == 1_000 and got.exceptAll(expected).isEmpty()


def test_a_label_folder_belongs_to_one_stream(spark, lexicon, landed, tmp_path):
    tokenize(spark, landed, tmp_path, max_files=1)
    score(spark, lexicon, tmp_path, "row")
    for plan, checkpoint, path in (
        ("row", "other-ck", "labels"),
        ("broadcast", "labels-ck", "labels"),
        ("row", "labels-ck", "other"),
    ):
        with pytest.raises(ValueError):
            score(spark, lexicon, tmp_path, plan, checkpoint, path)
    (tmp_path / "labels-ck").rename(tmp_path / "lost-ck")
    with pytest.raises(ValueError):
        score(spark, lexicon, tmp_path, "row")
    assert read_labels(spark, str(tmp_path / "labels")).count() == 1_000


def test_a_stream_that_does_not_end_is_an_error(spark, landed, tmp_path):
    stream = tokenize_lake(spark, landed, str(tmp_path / "tokens"), str(tmp_path / "ck"))
    with pytest.raises(TimeoutError):
        run_available(stream, 1)
    assert not stream.isActive
