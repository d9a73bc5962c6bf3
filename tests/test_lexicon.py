from postlens.sample_lexicon import sample_fields, sample_lines, sample_raw
from postlens.sources import (
    first_polarity,
    parse_keyed,
    parse_positional,
    read_lexicon,
    word_polarity,
)

import pytest


def as_dict(df):
    return {r.word: r.polarity for r in df.collect()}


@pytest.fixture
def sample_file(tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("\n".join(sample_lines()) + "\n")
    return str(path)


def test_44_lines(spark):
    assert sample_raw(spark).count() == sample_fields(spark).count() == 44


def test_irregular_lines(spark, sample_file):
    keyed = as_dict(read_lexicon(spark, sample_file, "keyed"))
    positional = as_dict(read_lexicon(spark, sample_file, "positional"))
    assert (keyed["odd"], keyed["short"]) == ("negative", "")
    assert (positional["odd"], positional["short"]) == (None, None)
    regular = set(keyed) - {"odd", "short"}
    assert {w: keyed[w] for w in regular} == {w: positional[w] for w in regular}


def test_first_line_wins(spark, sample_file):
    for form in ("keyed", "positional"):
        words = as_dict(read_lexicon(spark, sample_file, form))
        assert (words["as"], words["this"], words["like"]) == ("positive", "negative", "positive")
        assert len(words) == 41


def test_files_and_tables_agree(spark, sample_file):
    assert as_dict(read_lexicon(spark, sample_file, "keyed")) == as_dict(
        first_polarity(parse_keyed(sample_raw(spark)))
    )
    assert as_dict(read_lexicon(spark, sample_file, "positional")) == as_dict(
        first_polarity(parse_positional(sample_fields(spark)))
    )


def test_a_first_line_without_a_polarity_still_wins(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("type=a len=1 word1=w\ntype=a len=1 word1=w pos1=a s=n priorpolarity=both\n")
    assert as_dict(read_lexicon(spark, str(path), "keyed")) == {"w": ""}
    assert as_dict(read_lexicon(spark, str(path), "positional")) == {"w": None}


@pytest.mark.parametrize("form", ["keyed", "positional"])
def test_file_order_holds_when_a_file_is_cut_into_splits(spark, tmp_path, form):
    line = "type=weaksubj len=1 word1=w{} pos1=adj stemmed1=n priorpolarity={}"
    for part in ("a", "b"):
        lines = [line.format(i % 50, f"{part}{i}") for i in range(2_000)]
        (tmp_path / f"{part}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        words = as_dict(read_lexicon(spark, str(tmp_path), form))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert words == {f"w{i}": f"a{i}" for i in range(50)}


def test_word_polarity(spark, lexicon):
    assert [r.polarity for r in word_polarity(lexicon, "good").collect()] == ["positive"]
    assert [r.polarity for r in word_polarity(lexicon, "absent").collect()] == [""]


def test_unknown_form(spark):
    with pytest.raises(ValueError):
        read_lexicon(spark, "nowhere", "other")
