import pytest
from pyspark.sql import functions as F

from postlens.functions import (
    field_value,
    keyed_field,
    pair,
    pair_key,
    pair_value,
    tokenize,
    tokens_from_text,
    tokens_nw,
    tokens_to_text,
    tokens_ws,
    without_empty,
)


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a b", ["a", "b"]),
        ("a  b ", ["a", "", "b", ""]),
        ("a.\nb c", ["a.\nb", "c"]),
        ("", [""]),
    ],
)
def test_ws(spark, text, expected):
    assert value(spark, tokens_ws(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("don't", ["don", "t"]),
        ("Iechä", ["Iech", ""]),
        ("@a, b!", ["", "a", "b", ""]),
        ("snake_case 9", ["snake_case", "9"]),
        ("", [""]),
    ],
)
def test_nw(spark, text, expected):
    assert value(spark, tokens_nw(F.col("t")), t=text) == expected


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        tokenize(F.col("t"), "letters")


def test_text_form_of_tokens(spark):
    rows = spark.createDataFrame(
        [(["a", "b"],), (["a", None, ""],), ([],), (None,)], "t array<string>"
    )
    texts = [r.t for r in rows.select(tokens_to_text(F.col("t")).alias("t")).collect()]
    assert texts == ["[a, b]", "[a, null, ]", "[]", None]


def test_tokens_from_text(spark):
    assert value(spark, tokens_from_text(F.col("t")), t="[a, b,c, ]") == ["[a", "b,c", "]"]


def test_without_empty(spark):
    assert value(spark, without_empty(tokens_ws(F.col("t"))), t=" a  b ") == ["a", "b"]


@pytest.mark.parametrize(
    "field,expected", [("a=b", "b"), ("a=b=c", "b"), ("a=", ""), ("a", None), ("", None)]
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_field_value(spark, field, expected, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert value(spark, field_value(F.col("f")), f=field) == expected
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize(
    "line,word,polarity",
    [
        ("len=1 word1=a priorpolarity=positive", "a", "positive"),
        ("priorpolarity=negative x word1=a", "a", "negative"),
        ("word1=a word1=b priorpolarity=positive priorpolarity=both", "b", "both"),
        ("word1=a", "a", ""),
        ("priorpolarity=both", "", "both"),
        ("", "", ""),
        ("word1=priorpolarity", "priorpolarity", ""),
        ("word1 priorpolarity=both", "", "both"),
    ],
)
def test_keyed_field(spark, line, word, polarity):
    assert value(spark, keyed_field(F.col("v"), "word1"), v=line) == word
    found = keyed_field(F.col("v"), "priorpolarity", unless="word1")
    assert value(spark, found, v=line) == polarity


def test_pair(spark):
    assert value(spark, pair_key(pair(F.col("a"), F.col("b"))), a="k", b="v") == "k"
    assert value(spark, pair_value(pair(F.col("a"), F.col("b"))), a="k", b="v") == "v"
