"""The plans that the engine relies on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from postlens import lookup, sizing
from postlens.lookup import bloom
from postlens.operators import label_posts, label_report, match_rules, prepare_lexicon
from postlens.sizing import Size, fits_broadcast, measure, spread
from postlens.sources import has_next, page_posts, read_pages, rules_table


def plan_of(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_row_plan_shuffles_labels_only(lexicon, documents):
    report = label_report(label_posts(documents, lexicon, key="doc_id"))
    plan = plan_of(report)
    assert re.findall(r"Exchange (\w+)", plan) == ["SinglePartition", "hashpartitioning"]
    assert "hashpartitioning(label" in plan
    assert "Join" not in plan and "Generate" not in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_row_plan_scores_a_post_once(lexicon, documents):
    plan = plan_of(label_posts(documents, lexicon, key="doc_id"))
    assert plan.count("array_remove(") == 1 and plan.count("filter(_tokens") == 1
    assert len(re.findall(r"split\(text", plan)) == 1


def test_labels_alone_need_no_shuffle(lexicon, documents):
    assert "Exchange" not in plan_of(label_posts(documents, lexicon, key="doc_id"))


def test_broadcast_plan_adds_up_before_its_only_shuffle(lexicon, documents):
    prepared = prepare_lexicon(lexicon, "broadcast")
    plan = plan_of(label_posts(documents, prepared, key="doc_id"))
    assert "BroadcastHashJoin" in plan
    posts = plan.split("BroadcastHashJoin")[0]
    assert "SortAggregate" not in posts and posts.count("HashAggregate") == 2
    assert posts.count("Exchange hashpartitioning") == 1


def test_salted_plan_splits_hot_words(spark, lexicon, documents):
    prepared = prepare_lexicon(lexicon, "salted")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        plan = plan_of(label_posts(documents, prepared, key="doc_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert re.search(r"hashpartitioning\(word#\d+, _salt#\d+", plan)
    assert "SortMergeJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_kept_columns_do_not_follow_the_tokens(lexicon, documents):
    """Below the explode there are only numbers and the tokens, whatever is kept."""
    for strategy in ("broadcast", "salted"):
        prepared = prepare_lexicon(lexicon, strategy)
        labels = label_posts(documents, prepared, key="doc_id", keep=["text", "lang", "source"])
        plan = plan_of(labels, "formatted")
        generate = re.search(r"\(\d+\) Generate\nInput \[\d+\]: \[(.*)\]", plan).group(1)
        assert not re.search("text|lang|source", generate)
        assert labels.where("text IS NOT NULL").count() == documents.where("text IS NOT NULL").count()


def test_hot_keys_by_measured_share(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        key = F.when(F.col("id") < 4_000, "hot").when(F.col("id") < 5_000, "warm").otherwise(F.col("id").cast("string"))
        facts = spark.range(10_000).select("id", key.alias("k"))
        assert sizing.hot_keys(facts, "k") == {"hot": 8, "warm": 2}
        assert sizing.hot_keys(facts.where("false"), "k") == {}
        nulls = facts.select(F.lit(None).cast("string").alias("k"))
        assert sizing.hot_keys(nulls, "k") == {}
        dim = spark.createDataFrame([("hot", 1), ("warm", 2), ("9999", 3)], "k string, v int")
        joined = sizing.salted_join(facts, dim, "k", "inner", [F.col("id")])
        assert joined.groupBy("v").count().orderBy("v").collect() == [(1, 4_000), (2, 1_000), (3, 1)]
        # Only the rows of hot keys are repeated, once per part.
        plan = plan_of(joined)
        assert re.search(r"hashpartitioning\(k#\d+, _salt#\d+", plan) and "sequence(0, (coalesce(_parts" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_tokens_pass_a_bloom_filter(spark):
    words = spark.range(5_000).select(F.concat(F.lit("w"), "id").alias("word"))
    known = bloom(words, "word", 5_000)
    assert words.where(~known.passes(F.col("word"))).isEmpty()
    others = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("word"))
    assert others.where(known.passes(F.col("word"))).count() < 4_000
    assert not spark.createDataFrame([(None,)], "word string").where(known.passes(F.col("word"))).count() > 1
    none = bloom(words.where("false"), "word", 0)
    assert others.where(none.passes(F.col("word"))).isEmpty()


def test_a_filter_too_small_is_left_out(spark, monkeypatch):
    words = spark.range(1_000).select(F.col("id").cast("string").alias("word"))
    monkeypatch.setattr(lookup, "FILTER_BYTES", 1024)
    assert words.where(~bloom(words, "word", 1_000).passes(F.col("word"))).isEmpty()
    monkeypatch.setattr(lookup, "FILTER_BYTES", 256)
    assert bloom(words, "word", 1_000) is None


def test_tokens_are_filtered_before_the_shuffle(lexicon, documents):
    """What the salted join shuffles is hits and few others, and the labels are the same."""
    prepared = prepare_lexicon(lexicon, "salted")
    tokens = documents.select(F.explode(F.split("text", " ")).alias("word"))
    hits = tokens.join(prepared.table, "word").count()
    passed = tokens.where(prepared.known.passes(F.col("word"))).count()
    assert hits <= passed <= hits + 0.05 * tokens.count() < 0.5 * tokens.count()
    labels = label_posts(documents, prepared, key="doc_id")
    plan = plan_of(labels)
    shuffled = plan.split("Exchange hashpartitioning(word")[1].split("Exchange")[0]
    assert re.search(r"Filter .*xxhash64\(word#\d+, 0, 42\)", shuffled) and "Generate explode" in shuffled
    plain = label_posts(documents, prepared._replace(known=None), key="doc_id")
    assert labels.exceptAll(plain).isEmpty() and plain.exceptAll(labels).isEmpty()


def test_few_rules_reach_the_scan(spark, documents):
    rules = rules_table(spark, {"from:src2": "a", "from:src7": "b"})
    for tags in (True, False):
        plan = plan_of(match_rules(documents.select("doc_id", "source"), rules, "source", tags))
        assert re.search(r"PushedFilters: \[.*In\(source, \[src2,src7\]\)", plan)
        assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
        assert ("BroadcastHashJoin" in plan) == tags


def test_pages_read_only_what_is_asked(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"data":[{"id":"1","text":"a"}],"meta":{}}')
    pages = read_pages(spark, str(tmp_path))
    assert "ReadSchema: struct<meta:" in plan_of(pages.select(has_next()))
    assert "ReadSchema: struct<data:" in plan_of(page_posts(pages).select("text"))


def test_measure(spark):
    rows = spark.createDataFrame([("ab", 1), (None, 2), ("ä", 3)], "s string, i int")
    assert measure(rows) == Size(3, 2 + 2 + 3 * 16)
    assert measure(rows.filter("false")) == Size(0, 0)
    assert fits_broadcast(Size(sizing.BROADCAST_ROWS, sizing.BROADCAST_BYTES))
    assert not fits_broadcast(Size(sizing.BROADCAST_ROWS + 1, 0))
    assert not fits_broadcast(Size(0, sizing.BROADCAST_BYTES + 1))


def test_spread_only_when_cores_would_idle(spark, documents, tmp_path, monkeypatch):
    few = documents.select("doc_id")
    assert "RoundRobinPartitioning(4)" in plan_of(spread(few))
    spark.range(0, 1000, 1, 8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert "RoundRobin" not in plan_of(spread(many))
    monkeypatch.setattr(sizing, "PARTS_PER_SPLIT", 3)
    assert "RoundRobinPartitioning(3)" in plan_of(spread(few))
    monkeypatch.setattr(sizing, "SPREAD_SPLITS", 0)
    assert "RoundRobin" not in plan_of(spread(few))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "many"))
    assert spread(stream) is stream


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_a_plain_join(spark, how):
    hot = F.when(F.col("id") < 900, 7).otherwise(F.col("id") % 40)
    facts = spark.range(2_000).select("id", hot.alias("k"))
    dim = spark.range(30).select(F.col("id").alias("k"), F.col("id").alias("v"))
    salted = sizing.salted_join(facts, dim, "k", how, [F.col("id")]).select(
        *facts.join(dim, "k", how).columns
    )
    plain = facts.join(dim, "k", how)
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_a_large_lexicon_is_worked_out_once(spark):
    """Its words are made by one pass, though they are first counted and then written."""
    made = spark.sparkContext.accumulator(0)

    def word(i):
        made.add(1)
        return (f"w{i}",)

    words = spark.createDataFrame(spark.sparkContext.range(1_000).map(word), "word string").distinct()
    prepared = prepare_lexicon(words.withColumn("polarity", F.lit("positive")), row_words=10)
    assert prepared.strategy == "broadcast" and prepared.table.count() == 1_000
    assert made.value == 1_000


def test_salted_plan_without_sort_or_filter_where_they_do_not_help(spark):
    """All tokens are in the lexicon, so a filter is of no use; a part of it is small, so tokens stay unsorted."""
    words = spark.range(3_000).select(F.concat(F.lit("w"), "id").alias("word"))
    polarity = F.get(F.array(*map(F.lit, ("neutral", "positive", "negative"))), (F.col("id") % 3).cast("int"))
    lexicon = spark.range(3_000).select(F.concat(F.lit("w"), "id").alias("word"), polarity.alias("polarity"))
    prepared = prepare_lexicon(lexicon, "salted")
    text = F.concat_ws(" ", F.concat(F.lit("w"), "id"), F.concat(F.lit("w"), (F.col("id") * 7 + 1) % 3_000))
    posts = spark.range(3_000).select("id", text.alias("text")).union(spark.createDataFrame([(-1, None), (-2, "")], "id long, text string"))
    labels = label_posts(posts, prepared)
    plan = plan_of(labels)
    assert "ShuffledHashJoin" in plan and "xxhash64(word" not in plan
    assert labels.exceptAll(label_posts(posts, prepare_lexicon(lexicon, "row"))).isEmpty()
    others = posts.withColumn("text", F.concat_ws(" ", "text", *[F.concat(F.lit(f"x{i}y"), "id") for i in range(5)]))
    assert "xxhash64(word" in plan_of(label_posts(others, prepared))
    assert label_posts(others, prepared).exceptAll(label_posts(others, prepare_lexicon(lexicon, "row"))).isEmpty()
    assert words.count() == prepared.size.rows
