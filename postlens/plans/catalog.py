"""The registered queries: every operator over whole given tables.

Queries that need files as input write them from the tables first, below the
shared folder of the session, and then read them as the operator would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import (
    pair,
    pair_key,
    pair_value,
    tokens_from_text,
    tokens_nw,
    tokens_to_text,
    tokens_ws,
)
from ..operators import (
    file_summary,
    label_counts,
    label_posts,
    label_report,
    land_chunks,
    land_lines,
    match_rules,
    number_lines,
    page_chains,
    page_links,
    prepare_lexicon,
    roll_files,
)
from ..sample_lexicon import sample_raw
from ..schemas import CHAINED_PAGE
from ..sizing import spread
from ..sources import (
    field_kinds,
    first_polarity,
    has_next,
    infer_schema,
    page_counts,
    page_posts,
    parse_keyed,
    parse_pages,
    parse_positional,
    parse_rule_responses,
    read_keyed_lines,
    read_lines,
    read_pages,
    read_positional_fields,
    read_rules,
    read_tokens,
    rule_ids,
    rules_table,
    sample_file,
    schema_drift,
    store_rules,
    union_posts,
    word_polarity,
)
from ..streaming import add_rules, read_batch_counts, read_checked_tokens, read_labels, run_available
from ..workspace import new_folder
from .jobs import (
    account_report,
    compact_lake,
    follow_lake,
    labels_report,
    lake_report,
    land_files,
    land_live,
    page_gaps,
    running_report,
    score_lake,
    tokenize_checked,
    tokenize_lake,
)

STREAM_TIMEOUT = 6 * 60 * 60
ROW_GROUP_BYTES = 1024 * 1024

# The rules, the looked-up words and the landing size of the queries.
RULES = {"from:src2": "src2 account", "from:src7": "src7 account"}
LATER_RULES = {"from:src7": "src7 again", "from:src3": "src3 account"}
LOOKUP_TOKEN = "the"
LOOKUP_WORD = "red-7"
LINES_PER_FILE = 10
HOSTILE_WORDS = {
    "${env:HOME}": "positive",
    "${spark.app.name}": "negative",
    "don't": "negative",
    "a\\b": "positive",
    '"q"': "both",
}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations", "conv_id", "turn", "text")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    three_words = F.concat_ws(" ", "p_name", "p_type").alias("text")
    return _table(spark, sf_dir, "part", "p_partkey", "p_type", three_words)


def _sample_lexicon(spark: SparkSession) -> DataFrame:
    return first_polarity(parse_keyed(sample_raw(spark)))


def _sample_lexicon_file(spark: SparkSession) -> str:
    path = new_folder(spark, "lexicon")
    sample_raw(spark).select("value").coalesce(1).write.text(path)
    return path


# Sentiment


def sentiment_report_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_posts(_documents(spark, sf_dir), _sample_lexicon(spark), "ws", key="doc_id")
    return label_report(labels, "label")


def sentiment_report_nw(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_posts(_documents(spark, sf_dir), _sample_lexicon(spark), "nw", key="doc_id")
    return label_report(labels, "share")


def sentiment_labels_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_posts(_documents(spark, sf_dir), _sample_lexicon(spark), "ws", key="doc_id")


def sentiment_labels_nw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_posts(_documents(spark, sf_dir), _sample_lexicon(spark), "nw", key="doc_id")


def sentiment_labels_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = prepare_lexicon(_sample_lexicon(spark), "broadcast")
    return label_posts(_documents(spark, sf_dir), lexicon, "ws", key="doc_id")


def sentiment_labels_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = prepare_lexicon(_sample_lexicon(spark), "salted")
    return label_posts(_documents(spark, sf_dir), lexicon, "nw", key="doc_id")


def sentiment_ref_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _sample_lexicon(spark)
    return label_posts(_parts(spark, sf_dir), lexicon, "ws", "as_reference", key="p_partkey")


def sentiment_ref_nw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _sample_lexicon(spark)
    return label_posts(_parts(spark, sf_dir), lexicon, "nw", "as_reference", key="p_partkey")


def sentiment_single_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _sample_lexicon(spark)
    return label_posts(_parts(spark, sf_dir), lexicon, text="p_type", key="p_partkey")


def _repeated_keys(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """Turns keyed by their conversation alone, which repeats and is NULL for some."""
    key = F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("conv_id")
    posts = _conversations(spark, sf_dir).select(key, "text")
    return label_posts(posts, prepare_lexicon(_sample_lexicon(spark), strategy), "nw", key="conv_id")


def sentiment_keys_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated_keys(spark, sf_dir, "row")


def sentiment_keys_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated_keys(spark, sf_dir, "broadcast")


def sentiment_keys_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated_keys(spark, sf_dir, "salted")


def sentiment_large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents has a polarity, by its length."""
    posts = _documents(spark, sf_dir)
    words = posts.select(F.explode(tokens_ws(F.col("text"))).alias("word")).distinct()
    polarity = F.get(F.array(*map(F.lit, ("neutral", "positive", "negative"))), F.length("word") % 3)
    return label_posts(posts, words.where("word != ''").withColumn("polarity", polarity), key="doc_id")


def sentiment_hostile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words that SQL text would change, before every document."""
    words = spark.createDataFrame(list(HOSTILE_WORDS.items()), "word string, polarity string")
    listed = F.array(*map(F.lit, HOSTILE_WORDS))
    pick = lambda i: F.get(listed, F.pmod(F.col("doc_id") + i, F.lit(len(HOSTILE_WORDS))).cast("int"))
    posts = _documents(spark, sf_dir).select("doc_id", F.concat_ws(" ", pick(0), pick(1), "text").alias("text"))
    return label_posts(posts, prepare_lexicon(words, "row"), key="doc_id")


def labels_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = prepare_lexicon(_sample_lexicon(spark), "broadcast")
    return label_posts(_conversations(spark, sf_dir), lexicon, "nw", key="conv_id", keep=["turn", "text"])


def label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _conversations(spark, sf_dir)
    return label_counts(label_posts(posts, _sample_lexicon(spark), "nw", key=["conv_id", "turn"]))


# Tokens and pairs


def _token_counts(tokens: DataFrame) -> DataFrame:
    words = tokens.select(F.explode("tokens").alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def tokens_ws_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(_documents(spark, sf_dir).select(tokens_ws(F.col("text")).alias("tokens")))


def tokens_nw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(_documents(spark, sf_dir).select(tokens_nw(F.col("text")).alias("tokens")))


def tokens_from_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tokens_to_text(tokens_nw(F.col("text")))
    posts = _conversations(spark, sf_dir)
    return _token_counts(posts.select(tokens_from_text(flat).alias("tokens")))


def array_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tokens_to_text(tokens_nw(F.col("text"))).alias("text")
    return _documents(spark, sf_dir).select("doc_id", flat)


def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _conversations(spark, sf_dir)
    words = posts.select("conv_id", "turn", F.explode(tokens_ws(F.col("text"))).alias("word"))
    hits = words.filter(F.col("word") == LOOKUP_TOKEN)
    return hits.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))


def map_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "part", "p_partkey", pair(F.col("p_name"), F.col("p_type")).alias("value"))
    value = F.col("value")
    return pairs.select("p_partkey", pair_key(value).alias("name"), pair_value(value).alias("type"))


# Lexicon files, written from `part`: one line per part


def _part_lexicon_file(spark: SparkSession, sf_dir: str) -> str:
    """Words come back in several lines, some lines have a seventh field, some no polarity."""
    size = F.col("p_size")
    polarity = F.element_at(
        F.array(*[F.lit(p) for p in ("positive", "negative", "neutral", "both")]),
        (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"),
    )
    line = F.concat(
        F.lit("type=weaksubj len=1 word1="),
        F.split("p_name", " ")[0],
        F.lit("-"),
        size.cast("string"),
        F.lit(" pos1=adj stemmed1=n"),
        F.when(size % 7 == 0, " m").otherwise(""),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit(" priorpolarity="), polarity)),
    )
    path = new_folder(spark, "part-lexicon")
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    parts.orderBy("p_partkey").select(line.alias("value")).write.text(path)
    return path


def lexicon_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_keyed_lines(spark, _part_lexicon_file(spark, sf_dir))
    return parse_keyed(lines).select("word", "polarity")


def lexicon_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read_positional_fields(spark, _part_lexicon_file(spark, sf_dir))
    return parse_positional(fields).select("word", "polarity")


def lexicon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_keyed_lines(spark, _part_lexicon_file(spark, sf_dir))
    return first_polarity(parse_keyed(lines))


def lexicon_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_polarity(lexicon_dedup(spark, sf_dir), LOOKUP_WORD)


# Pages and rules


def _stored_pages(spark: SparkSession, sf_dir: str) -> str:
    """A page per document, a post per line of it; every page but the last names the next."""
    documents = _documents(spark, sf_dir)
    last = _last_document(spark, sf_dir)
    posts = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.concat_ws("-", "doc_id", i).alias("id"), line.alias("text")),
    )
    path = new_folder(spark, "pages")
    documents.select(
        posts.alias("data"), F.struct(_next_token(last).alias("next_token")).alias("meta")
    ).write.json(path)
    return path


def corrupt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every tenth was cut off half-way."""
    lines = spark.read.text(_stored_pages(spark, sf_dir))
    number = F.regexp_extract("value", r'"id":"(\d+)-0"', 1).cast("bigint")
    cut = F.when(number % 10 == 3, F.substr("value", F.lit(1), (F.length("value") / 2).cast("int")))
    path = new_folder(spark, "cut-pages")
    lines.select(F.coalesce(cut, "value").alias("value")).write.text(path)
    return page_counts(spark, path)


def account_rules_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose posts carry an account, and a report of those that stored rules name."""
    documents = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("account"))
    pages, rules = new_folder(spark, "pages"), new_folder(spark, "rules")
    documents.select(F.array(post).alias("data")).write.json(pages)
    store_rules(rules_table(spark, RULES), rules)
    return account_report(spark, pages, _sample_lexicon_file(spark), rules=rules)


def _chained_pages(spark: SparkSession, sf_dir: str) -> str:
    """A page per document, chained within its source, of which every seventh was lost."""
    documents = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    order = Window.partitionBy("source").orderBy("doc_id")
    token = F.when(F.lag("doc_id").over(order).isNotNull(), F.col("doc_id").cast("string"))
    following = F.lead("doc_id").over(order).cast("string")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("account"))
    pages = documents.select(
        "doc_id",
        F.array(post).alias("data"),
        F.struct(following.alias("next_token")).alias("meta"),
        F.col("source").alias("account"),
        token.alias("token"),
    )
    path = new_folder(spark, "chained-pages")
    pages.where("doc_id % 7 != 3").drop("doc_id").write.json(path)
    return path


def chained_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(spark, _chained_pages(spark, sf_dir), CHAINED_PAGE)
    return page_chains(page_links(pages))


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_gaps(spark, _chained_pages(spark, sf_dir))


def _last_document(spark: SparkSession, sf_dir: str) -> Column:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).scalar()


def _next_token(last: Column) -> Column:
    return F.when(F.col("doc_id") < last, (F.col("doc_id") + 1).cast("string"))


def flatten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_posts(read_pages(spark, _stored_pages(spark, sf_dir)))


def page_has_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last_document(spark, sf_dir)
    meta = F.concat(
        F.lit('{"meta":{"result_count":'),
        F.col("n_chars").cast("string"),
        F.coalesce(F.concat(F.lit(',"next_token":"'), _next_token(last), F.lit('"')), F.lit("")),
        F.lit("}}"),
    )
    pages = _table(spark, sf_dir, "documents", "doc_id", "n_chars")
    parsed = parse_pages(pages.select("doc_id", meta.alias("value")))
    return parsed.select("doc_id", has_next().alias("has_next"))


def union_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    others = turns.filter(F.col("role") != "user").select("turn", "conv_id", "role", "text")
    return union_posts(asked, others)


def rules_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per customer; some have no ids, some no meta."""
    nation, customer = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    data = F.concat(
        F.lit('"data":[{"id":"'), customer, F.lit('"},{"id":"'), customer, F.lit('-2"}]')
    )
    meta = F.lit('"meta":{"sent":"now"}')
    response = F.concat(
        F.lit("{"),
        F.when(nation % 5 == 0, meta).when(nation % 7 == 0, data).otherwise(F.concat_ws(",", data, meta)),
        F.lit("}"),
    )
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    responses = parse_rule_responses(customers.select("c_custkey", response.alias("value")))
    return rule_ids(responses)


def _stored_rules(spark: SparkSession) -> DataFrame:
    """The rules, stored in place of earlier ones."""
    path = new_folder(spark, "rules")
    store_rules(rules_table(spark, {"from:src3": "an earlier rule"}), path)
    store_rules(rules_table(spark, RULES), path)
    return read_rules(spark, path)


def matched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return match_rules(posts, _stored_rules(spark), "source").select("doc_id", "source", "tag")


def ruled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return match_rules(posts, _stored_rules(spark), "source", tags=False)


# JSON lines, streams


def json_infer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.col("ts").cast("string")
    others = ("event_id", "user_id", "event_type", "value", "props")
    events = _table(spark, sf_dir, "events", time, *others)
    path = new_folder(spark, "events")
    events.write.json(path)
    return read_lines(spark, path, infer_schema(spark, sample_file(spark, path)))


def drifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two landings; in the second one field is new and another is text at times."""
    time = F.col("ts").cast("string").alias("time")
    events = _table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", time)
    path = new_folder(spark, "events")
    number = F.struct("value", "time").alias("reading")
    events.where("event_type != 'purchase'").select("event_id", "user_id", number).write.json(path)
    shown = F.struct(F.col("value").cast("string").alias("value"), "time").alias("reading")
    later = events.where("event_type = 'purchase'")
    later.select("event_id", "user_id", shown, F.array("event_type").alias("tags")).write.mode("append").json(path)
    drift = schema_drift(field_kinds(spark, path))
    return drift.select(F.array_join("path", "/").alias("path"), F.array_join("kinds", " ").alias("kinds"), "n_values", "conflict")


def _stream_line() -> Column:
    post = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text"))
    return post.alias("data")


def _landed_documents(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "landed")
    _documents(spark, sf_dir).select(_stream_line()).write.json(path)
    return path


def _third(spark: SparkSession, path: str) -> int:
    """A third of the files of a folder, so that a stream over them takes three batches."""
    return max(1, len(spark.read.text(path).inputFiles()) // 3)


def _token_lake(spark: SparkSession, sf_dir: str, row_group_bytes: int | None = None) -> str:
    path, landed = new_folder(spark, "tokens"), _landed_documents(spark, sf_dir)
    stream = tokenize_lake(
        spark,
        landed,
        path,
        new_folder(spark, "tokens-checkpoint"),
        available_now=True,
        max_files=_third(spark, landed),
        row_group_bytes=row_group_bytes,
    )
    run_available(stream, STREAM_TIMEOUT)
    return path


def streamed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = read_tokens(spark, _token_lake(spark, sf_dir))
    return _token_counts(lake.select(F.col("text").alias("tokens")))


def compacted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table in fewer files, and whether they are fewer."""
    tokens, path = _token_lake(spark, sf_dir), new_folder(spark, "compact")
    run_available(compact_lake(spark, tokens, path, new_folder(spark, "compact-checkpoint"), files=1), STREAM_TIMEOUT)
    fewer = len(read_tokens(spark, path).inputFiles()) < len(read_tokens(spark, tokens).inputFiles())
    return read_tokens(spark, path).select("id", F.size("text").alias("n_tokens"), F.lit(fewer).alias("fewer_files"))


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake_report(spark, _token_lake(spark, sf_dir), _sample_lexicon_file(spark))


def _streamed_labels(spark: SparkSession, sf_dir: str) -> str:
    path, tokens = new_folder(spark, "labels"), _token_lake(spark, sf_dir)
    stream = score_lake(
        spark,
        tokens,
        _sample_lexicon_file(spark),
        path,
        new_folder(spark, "labels-checkpoint"),
        available_now=True,
        max_files=_third(spark, tokens),
    )
    run_available(stream, STREAM_TIMEOUT)
    return path


def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_labels(spark, _streamed_labels(spark, sf_dir)).select("id", "score", "label")


def stream_labels_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_report(spark, _streamed_labels(spark, sf_dir))


def _land_half(spark: SparkSession, sf_dir: str, path: str, half: int) -> None:
    """Every second document, after those that landed before; each tenth line is cut short."""
    posts = _table(spark, sf_dir, "documents", "doc_id", "text", "source").where(F.col("doc_id") % 2 == half)
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("account"))
    line = F.to_json(F.struct(post.alias("data")))
    cut = F.when(F.col("doc_id") % 10 == 3, F.substr(line, F.lit(1), (F.length(line) / 2).cast("int")))
    posts.select(F.coalesce(cut, line).alias("value")).write.mode("append").text(path)


def _checked_tokens(spark: SparkSession, sf_dir: str) -> str:
    """Two landings, between which the rules change; the stream is started again for each."""
    path, checkpoint = new_folder(spark, "checked"), new_folder(spark, "checked-checkpoint")
    landed, rules = new_folder(spark, "landed"), new_folder(spark, "rules")
    for half, in_force in enumerate((RULES, LATER_RULES)):
        _land_half(spark, sf_dir, landed, half)
        add_rules(rules_table(spark, in_force), rules)
        stream = tokenize_checked(spark, landed, path, checkpoint, rules, available_now=True)
        run_available(stream, STREAM_TIMEOUT)
    return path


def stream_ruled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read_checked_tokens(spark, _checked_tokens(spark, sf_dir))
    return tokens.select("id", F.size("text").alias("n_tokens"), "account", "tag")


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_batch_counts(spark, _checked_tokens(spark, sf_dir))
    return counts.groupBy("rules_version").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_rejected").alias("n_rejected")
    )


def stream_running_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of one half are followed in several batches, then, after a restart, the others."""
    landed, tokens, report = (new_folder(spark, name) for name in ("landed", "tokens", "report"))
    checkpoints = [new_folder(spark, f"{name}-checkpoint") for name in ("tokens", "report")]
    lexicon = _sample_lexicon_file(spark)
    for half in (0, 1):
        posts = _documents(spark, sf_dir).where(F.col("doc_id") % 2 == half)
        posts.select(_stream_line()).write.mode("append").json(landed)
        stream = tokenize_lake(spark, landed, tokens, checkpoints[0], available_now=True)
        run_available(stream, STREAM_TIMEOUT)
        files = _third(spark, tokens)
        run_available(
            follow_lake(spark, tokens, lexicon, report, checkpoints[1], available_now=True, max_files=files),
            STREAM_TIMEOUT,
        )
    return running_report(spark, report)


def sink_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = read_tokens(spark, _token_lake(spark, sf_dir, ROW_GROUP_BYTES))
    return lake.select("id", F.size("text").alias("n_tokens"))


def batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_report(spark, _stored_pages(spark, sf_dir), _sample_lexicon_file(spark))


# Landing


def rolled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "documents", "doc_id")
    return file_summary(roll_files(number_lines(keys, "doc_id"), LINES_PER_FILE))


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select(
        "doc_id", F.to_json(F.struct(_stream_line())).alias("value")
    )
    path = new_folder(spark, "files")
    land_lines(roll_files(number_lines(lines, "doc_id"), LINES_PER_FILE), path)
    return spark.read.json(path, schema="data struct<id:string,text:string>, file_no bigint").select(
        "file_no", "data.*"
    )


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in files that follow each other, landed by their place in them."""
    lines, path = new_folder(spark, "lines"), new_folder(spark, "files")
    ordered = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.to_json(F.struct(_stream_line())).alias("value")).write.text(lines)
    land_files(spark, lines, path, LINES_PER_FILE)
    return spark.read.json(path, schema="data struct<id:string,text:string>, file_no bigint").select(
        "file_no", "data.*"
    )


def landed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select(F.to_json(F.struct(_stream_line())).alias("value"))
    path = new_folder(spark, "chunks")
    land_chunks(lines, path, LINES_PER_FILE)
    return _landed_posts(spark, path)


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, landed = new_folder(spark, "live"), _landed_documents(spark, sf_dir)
    stream = land_live(
        spark,
        landed,
        path,
        new_folder(spark, "live-checkpoint"),
        LINES_PER_FILE,
        available_now=True,
        max_files=_third(spark, landed),
    )
    run_available(stream, STREAM_TIMEOUT)
    return _landed_posts(spark, path)


def _landed_posts(spark: SparkSession, path: str) -> DataFrame:
    """The landed posts, and whether their file has no more lines than it may."""
    posts = spark.read.json(path, schema="data struct<id:string,text:string>").select(
        "data.*", F.col("_metadata.file_path").alias("file")
    )
    lines = F.count(F.lit(1)).over(Window.partitionBy("file"))
    return posts.withColumn("within_size", lines <= LINES_PER_FILE).drop("file")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sentiment_report_ws": sentiment_report_ws,
    "sentiment_report_nw": sentiment_report_nw,
    "sentiment_labels_ws": sentiment_labels_ws,
    "sentiment_labels_nw": sentiment_labels_nw,
    "sentiment_labels_broadcast": sentiment_labels_broadcast,
    "sentiment_labels_salted": sentiment_labels_salted,
    "sentiment_ref_ws": sentiment_ref_ws,
    "sentiment_ref_nw": sentiment_ref_nw,
    "sentiment_single_token": sentiment_single_token,
    "sentiment_keys_row": sentiment_keys_row,
    "sentiment_keys_broadcast": sentiment_keys_broadcast,
    "sentiment_keys_salted": sentiment_keys_salted,
    "sentiment_large_lexicon": sentiment_large_lexicon,
    "sentiment_hostile_words": sentiment_hostile_words,
    "labels_with_text": labels_with_text,
    "label_counts": label_count,
    "lexicon_keyed": lexicon_keyed,
    "lexicon_positional": lexicon_positional,
    "lexicon_dedup": lexicon_dedup,
    "lexicon_word": lexicon_word,
    "word_lookup": word_lookup,
    "tokens_ws": tokens_ws_counts,
    "tokens_nw": tokens_nw_counts,
    "tokens_from_text": tokens_from_text_counts,
    "array_to_text": array_to_text,
    "map_pair": map_pair,
    "json_infer_scan": json_infer_scan,
    "schema_drift": drifted_events,
    "flatten_pages": flatten_pages,
    "union_pages": union_pages,
    "page_has_next": page_has_next,
    "account_report": batch_job,
    "account_rules_report": account_rules_report,
    "page_chains": chained_pages,
    "page_gaps": missing_pages,
    "corrupt_pages": corrupt_pages,
    "rule_ids": rules_in_force,
    "match_rules": matched_rules,
    "match_rules_semi": ruled_posts,
    "stream_tokens": streamed_tokens,
    "stream_report": stream_report,
    "stream_compacted": compacted_tokens,
    "stream_labels": stream_labels,
    "stream_labels_report": stream_labels_report,
    "stream_running_report": stream_running_report,
    "stream_ruled_tokens": stream_ruled_tokens,
    "stream_rejected": stream_rejected,
    "stream_landing": stream_landing,
    "sink_row_groups": sink_row_groups,
    "roll_files": rolled_files,
    "land_lines": landed_lines,
    "land_files": landed_files,
    "land_chunks": landed_chunks,
}
