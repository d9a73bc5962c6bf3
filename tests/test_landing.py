import json
import pathlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postlens.operators import file_summary, land_chunks, land_lines, number_lines, number_text, roll_files
from postlens.plans import land_files, land_live, tokenize_lake
from postlens.sources import read_tokens
from postlens.streaming import run_available
from postlens.workspace import shared_root


def files(path):
    """file_no -> lines, as they stand in the files."""
    found = {}
    for folder in pathlib.Path(path).glob("file_no=*"):
        (file,) = folder.glob("part-*")
        found[int(folder.name.split("=")[1])] = file.read_text().splitlines()
    return found


@pytest.mark.parametrize("n", [0, 1, 9, 10, 20, 1000])
def test_published_files(spark, n):
    rolled = roll_files(number_lines(spark.range(n), "id"))
    got = {r.file_no: (r.n_lines, r.published) for r in file_summary(rolled).collect()}
    sizes = {}
    for line in range(1, n + 1):
        sizes[line // 10 + 1] = sizes.get(line // 10 + 1, 0) + 1
    assert got == {k: (size, k <= n // 10) for k, size in sizes.items()}


def test_numbers_follow_the_order_and_have_no_gaps(spark):
    rows = spark.range(5_000).select(
        ((F.col("id") * 7919) % 5_000).alias("key"), F.hash("id").alias("payload")
    )
    for ranges in (None, 13):
        numbered = number_lines(rows.repartition(9), "key", ranges).collect()
        assert len(numbered) == 5_000
        assert all(r.line_no == r.key + 1 and r.line_count == 5_000 for r in numbered)


def test_numbers_by_two_keys_when_one_value_dominates(spark):
    rows = spark.range(3_000).select(
        F.when(F.col("id") < 2_500, 1).otherwise(F.col("id") % 5).alias("a"), F.col("id").alias("b")
    )
    numbered = sorted(number_lines(rows.repartition(5), ["a", "b"]).collect(), key=lambda r: r.line_no)
    assert [r.line_no for r in numbered] == list(range(1, 3_001))
    assert [(r.a, r.b) for r in numbered] == sorted((r.a, r.b) for r in rows.collect())


def test_landed_files_hold_their_lines_in_order(spark, tmp_path):
    lines = spark.range(1, 138).select("id", F.concat(F.lit("line "), "id").alias("value"))
    land_lines(roll_files(number_lines(lines.repartition(5), "id")), str(tmp_path / "out"))
    assert files(tmp_path / "out") == {
        k: [f"line {n}" for n in range(1, 131) if n // 10 + 1 == k] for k in range(1, 14)
    }


def test_landing_twice_is_an_error(spark, tmp_path):
    rolled = roll_files(number_lines(spark.range(25).select("id", F.lit("x").alias("value")), "id"))
    land_lines(rolled, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        land_lines(rolled, str(tmp_path / "out"))


def test_land_files_numbers_in_file_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps({"data": {"id": str(i)}}) for i in range(1, 1001)]
    (source / "a").write_text("\n".join(lines[:600]) + "\n")
    (source / "b").write_text("\n".join(lines[600:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        land_files(spark, str(source), str(tmp_path / "out"), per_file=100)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    landed = files(tmp_path / "out")
    assert [len(landed[k]) for k in range(1, 11)] == [99] + [100] * 9
    assert [line for k in range(1, 11) for line in landed[k]] == lines[:999]


def test_splits_that_changed_are_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text("".join(f"{name}{i}\n" for i in range(3_000)))
    numbered = number_text(spark, str(tmp_path / "in"))
    assert [r.value for r in numbered.orderBy("line_no").collect()] == [f"{n}{i}" for n in "ab" for i in range(3_000)]
    assert {r.line_count for r in numbered.select("line_count").distinct().collect()} == {6_000}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        with pytest.raises(Exception, match="splits of the text are not those"):
            numbered.select("line_no").where("line_no > 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("few", [True, False])
def test_landing_shuffles_the_text_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("postlens.operators.numbering.fits_broadcast", lambda size: few)
    (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / "in" / name).write_text("".join(f"{name} line {i}\n" for i in range(100)))
    numbered = number_text(spark, str(tmp_path / "in"))
    if not few:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == (0 if few else 2) and "rangepartitioning" not in plan
    shared = pathlib.Path(shared_root(spark)) / "postlens"
    counted = max(shared.glob("splits-*"), key=lambda p: p.stat().st_mtime)
    assert "value" not in spark.read.parquet(str(counted)).columns
    assert [r.value for r in numbered.orderBy("line_no").collect()] == [f"{n} line {i}" for n in "abc" for i in range(100)]
    land_lines(roll_files(numbered), str(tmp_path / "out"))
    assert files(tmp_path / "out")[30][-1] == "c line 98"


def test_no_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty").write_text("")
    assert number_text(spark, str(tmp_path / "in")).count() == 0


def test_chunks(spark, tmp_path):
    lines = spark.range(1_000).repartition(3).select(F.col("id").cast("string").alias("value"))
    land_chunks(lines, str(tmp_path / "out"))
    texts = [p.read_text().splitlines() for p in (tmp_path / "out").glob("part-*")]
    assert max(map(len, texts)) == 10
    assert sorted(int(x) for t in texts for x in t) == list(range(1_000))


def test_live_landing_feeds_the_tokenizer_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    number = 0
    for batch in range(3):
        lines = []
        for _ in range(47):
            lines.append(json.dumps({"data": {"id": str(number), "text": f"post {number}"}}))
            number += 1
        (source / f"{batch}.json").write_text("\n".join(lines) + "\n")
        jobs = ((land_live, source, "landed"), (tokenize_lake, tmp_path / "landed", "tokens"))
        for start, path, out in jobs:
            stream = start(
                spark, str(path), str(tmp_path / out), str(tmp_path / f"{out}-ck"), available_now=True
            )
            run_available(stream, 120)
    landed = [p.read_text().splitlines() for p in (tmp_path / "landed").glob("part-*")]
    assert max(map(len, landed)) == 10 and sum(map(len, landed)) == 3 * 47
    tokens = read_tokens(spark, str(tmp_path / "tokens")).collect()
    assert sorted(int(r.id) for r in tokens) == list(range(3 * 47))
    assert all(r.text == ["post", r.id] for r in tokens)
