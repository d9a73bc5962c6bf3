import pyarrow as pa
import pytest
from brute import clean, printed
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.operators import label_posts, label_report, label_tokens, prepare_lexicon
from postlens.operators import sentiment

# text, then the labels for ws clean, ws as_reference, nw clean, nw as_reference
HAND = [
    ("good", "positive", "mixed", "positive", "mixed"),
    ("good ", "positive", "mixed", "positive", "mixed"),
    ("good.", "mixed", "mixed", "positive", "mixed"),
    ("good good bad", "positive", "positive", "positive", "positive"),
    ("bad x good", "mixed", "mixed", "mixed", "mixed"),
    ("x good bad", "mixed", "positive", "mixed", "positive"),
    ("so good today", "positive", "positive", "positive", "positive"),
    ("so happy!", "mixed", "mixed", "positive", "positive"),
    ("so good, so bad", "negative", "mixed", "mixed", "positive"),
    ("calm", "neutral", "mixed", "neutral", "mixed"),
    ("mood", "both", "mixed", "both", "mixed"),
    ("calm mood", "mixed", "mixed", "mixed", "mixed"),
    ("Good day", "mixed", "mixed", "mixed", "mixed"),
    ("a\ngood b", "mixed", "mixed", "positive", "positive"),
    ("@u awful", "negative", "mixed", "negative", "mixed"),
    ("", "mixed", "mixed", "mixed", "mixed"),
    (None, "mixed", "mixed", "mixed", "mixed"),
    ("like", "positive", "mixed", "positive", "mixed"),
    ("don't like it", "mixed", "positive", "mixed", "positive"),
    ("happy bad", "mixed", "mixed", "mixed", "mixed"),
    (" good x", "positive", "positive", "positive", "positive"),
    ("x odd y", "negative", "negative", "negative", "negative"),
    ("short", "mixed", "mixed", "mixed", "mixed"),
]
MODES = [("ws", "clean"), ("ws", "as_reference"), ("nw", "clean"), ("nw", "as_reference")]
PLANS = ["row", "broadcast", "salted"]

REPORTS = {
    ("documents", "ws", "clean"): {"mixed": 169, "negative": 540, "neutral": 1, "positive": 290},
    ("documents", "ws", "as_reference"): {"mixed": 170, "negative": 540, "positive": 290},
    ("documents", "nw", "clean"): {"mixed": 121, "negative": 669, "positive": 210},
    ("documents", "nw", "as_reference"): {"mixed": 121, "negative": 669, "positive": 210},
    ("parts", "ws", "clean"): {"mixed": 932, "negative": 507, "positive": 561},
    ("parts", "nw", "clean"): {"mixed": 932, "negative": 507, "positive": 561},
    ("parts", "ws", "as_reference"): {"mixed": 1491, "negative": 248, "positive": 261},
    ("parts", "nw", "as_reference"): {"mixed": 1491, "negative": 248, "positive": 261},
    ("types", "ws", "clean"): {
        "both": 353, "mixed": 683, "negative": 322, "neutral": 311, "positive": 331
    },
    ("types", "nw", "as_reference"): {"mixed": 2000},
}


def frame(spark, texts):
    ids = pa.array([str(i) for i in range(len(texts))])
    return spark.createDataFrame(pa.table({"id": ids, "text": pa.array(texts, pa.string())}))


def labels_of(df):
    return [r.label for r in sorted(df.collect(), key=lambda r: int(r.id))]


@pytest.fixture(scope="module", params=PLANS)
def plan(request, lexicon):
    return prepare_lexicon(lexicon, request.param)


@pytest.mark.parametrize("column,mode", list(enumerate(MODES, 1)))
def test_hand_table(spark, plan, column, mode):
    posts = frame(spark, [row[0] for row in HAND])
    assert labels_of(label_posts(posts, plan, *mode)) == [row[column] for row in HAND]


@pytest.mark.parametrize("case", list(REPORTS))
def test_reports(spark, lexicon, documents, parts, case):
    source, tokenizer, edges = case
    posts = {
        "documents": documents.withColumnRenamed("doc_id", "id"),
        "parts": parts,
        "types": parts.select("id", F.col("p_type").alias("text")),
    }[source]
    report = label_report(label_posts(posts, lexicon, tokenizer, edges)).collect()
    assert {r.label: r.n for r in report} == REPORTS[case]
    assert sum(r.n for r in report) == posts.count()
    assert abs(sum(r.pct for r in report) - 100) < 0.05


def test_auto_takes_the_row_plan_for_a_small_lexicon(lexicon):
    assert prepare_lexicon(lexicon).strategy == "row"


def test_auto_leaves_the_row_plan_when_the_lexicon_grows(lexicon, monkeypatch):
    assert prepare_lexicon(lexicon, row_words=10).strategy == "broadcast"
    monkeypatch.setattr(sentiment, "WORD_BYTES", 3)
    assert prepare_lexicon(lexicon).strategy == "broadcast"
    monkeypatch.setattr("postlens.sizing.BROADCAST_ROWS", 10)
    assert prepare_lexicon(lexicon).strategy == "salted"


def test_a_named_plan_the_lexicon_does_not_fit_is_an_error(lexicon, monkeypatch):
    with pytest.raises(ValueError):
        prepare_lexicon(lexicon, "row", row_words=10)
    monkeypatch.setattr("postlens.sizing.BROADCAST_BYTES", 10)
    with pytest.raises(ValueError):
        prepare_lexicon(lexicon, "broadcast")


def test_copies_count_separately(spark, lexicon):
    posts = frame(spark, ["so good today"] * 3 + ["so bad today"])
    report = label_report(label_posts(posts, lexicon)).collect()
    assert [(r.label, r.n, r.pct) for r in report] == [("negative", 1, 25.0), ("positive", 3, 75.0)]


@pytest.mark.parametrize("plan", ["row", "broadcast", "salted"])
def test_keys_may_repeat_or_be_missing(spark, lexicon, plan):
    rows = [("1", "good x"), ("1", "bad x"), (None, "good x"), (None, "bad x"), ("2", "good x")]
    posts = spark.createDataFrame(rows, "id string, text string")
    labels = label_posts(posts, prepare_lexicon(lexicon, plan), keep=["text"]).collect()
    assert sorted((str(r.id), r.text, r.label) for r in labels) == sorted(
        (str(i), t, "positive" if "good" in t else "negative") for i, t in rows
    )


@pytest.mark.parametrize("plan", ["row", "broadcast", "salted"])
def test_a_prepared_lexicon_does_not_change(spark, tmp_path, plan):
    path = str(tmp_path / "words")
    words = spark.createDataFrame([("good", "positive")], "word string, polarity string")
    words.write.parquet(path)
    lookup = prepare_lexicon(spark.read.parquet(path), plan)
    words.selectExpr("word", "'negative' AS polarity").write.mode("overwrite").parquet(path)
    posts = spark.createDataFrame([("1", "so good")], "id string, text string")
    assert label_posts(posts, lookup).first().label == "positive"


def test_words_with_quotes_and_backslashes(spark):
    words = {
        "don't": "negative", "a\\b": "positive", 'say"': "positive", "\\'": "negative",
        "${env:HOME}": "positive", "${spark.app.name}": "negative", "a\nb": "positive", "$": "negative",
    }
    table = spark.createDataFrame(
        pa.table({"word": list(words), "polarity": list(words.values())})
    )
    texts = [f"x {w} y" for w in words] + list(words)
    for strategy in PLANS:
        labels = label_posts(frame(spark, texts), prepare_lexicon(table, strategy))
        assert labels_of(labels) == list(words.values()) * 2


def test_empty_lexicon(spark, lexicon):
    nothing = lexicon.filter("false")
    for strategy in PLANS:
        labels = label_posts(frame(spark, ["good", "so good"]), prepare_lexicon(nothing, strategy))
        assert labels_of(labels) == ["mixed", "mixed"]


def test_one_hot_word_and_a_very_long_post(spark, plan):
    texts = ["good " * 50_000 + "bad", "bad " * 1_000 + "good"] + ["good x"] * 200
    assert labels_of(label_posts(frame(spark, texts), plan)) == (
        ["positive", "negative"] + ["positive"] * 200
    )


def test_labels_do_not_depend_on_partitions(spark, lexicon, documents):
    posts = documents.select(F.col("doc_id").alias("id"), "text")
    once = label_posts(posts, lexicon, "nw")
    again = label_posts(posts.repartition(7), lexicon.repartition(3), "nw")
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_null_tokens_are_not_found(spark, plan):
    posts = spark.createDataFrame(
        [("0", ["good", None, "x"]), ("1", None), ("2", [])], "id string, text array<string>"
    )
    assert labels_of(label_tokens(posts, plan)) == ["positive", "mixed", "mixed"]


def test_ansi_mode_off(spark, lexicon):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        posts = frame(spark, [row[0] for row in HAND])
        for column, mode in enumerate(MODES, 1):
            assert labels_of(label_posts(posts, lexicon, *mode)) == [row[column] for row in HAND]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("wrong", [{"edges": "x"}, {"tokenizer": "x"}])
def test_unknown_modes(spark, lexicon, wrong):
    with pytest.raises(ValueError):
        label_posts(frame(spark, ["a"]), lexicon, **wrong)


WORDS = ["good", "bad", "calm", "like", "as", "x", "", "don't", "good.", "@bad", "Iechä", "a\nb"]
TEXT = st.one_of(
    st.none(), st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join), st.text(max_size=12)
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(TEXT, min_size=40, max_size=80))
def test_against_brute_force(spark, lexicon, plan, texts):
    texts = [t if t is None else t.replace("\x00", "") for t in texts]
    words = {r.word: r.polarity for r in lexicon.collect()}
    posts = frame(spark, texts)
    for tokenizer in ("ws", "nw"):
        assert labels_of(label_posts(posts, plan, tokenizer, "clean")) == [
            clean(t, words, tokenizer) for t in texts
        ]
        assert labels_of(label_posts(posts, plan, tokenizer, "as_reference")) == [
            printed(t, words, tokenizer) for t in texts
        ]
