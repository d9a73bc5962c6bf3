"""Word-polarity lexicons in their two line formats.

Keyed: fields are found by name, in any position. Positional: the third and the
sixth field of a space-separated line. Both give `word`, `polarity` and `ord`,
the place of the line in the file, which decides between lines of one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import field_value, keyed_field
from ..schemas import LEXICON_FIELDS


def _file_order() -> Column:
    """Sorts as the lines stand in the files, however the files are split among tasks.

    Lines of one split are read in order by one task, and the splits of a file are
    told apart by where they start.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(_file_order().alias("ord"), "value")


def read_positional_fields(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.schema(LEXICON_FIELDS).option("sep", " ").csv(path)
    return fields.select(_file_order().alias("ord"), *LEXICON_FIELDS.names)


def parse_keyed(lines: DataFrame) -> DataFrame:
    """A missing word or polarity is the empty string."""
    value = F.col("value")
    return lines.select(
        "ord",
        keyed_field(value, "word1").alias("word"),
        keyed_field(value, "priorpolarity", unless="word1").alias("polarity"),
    )


def parse_positional(fields: DataFrame) -> DataFrame:
    """A missing word or polarity is NULL."""
    return fields.select(
        "ord",
        field_value(F.col("word")).alias("word"),
        field_value(F.col("sentiment")).alias("polarity"),
    )


def first_polarity(parsed: DataFrame) -> DataFrame:
    """One row per word: the polarity of its first line."""
    return parsed.groupBy("word").agg(F.min_by("polarity", "ord").alias("polarity"))


def read_lexicon(spark: SparkSession, path: str, form: str = "keyed") -> DataFrame:
    if form == "keyed":
        return first_polarity(parse_keyed(read_keyed_lines(spark, path)))
    if form == "positional":
        return first_polarity(parse_positional(read_positional_fields(spark, path)))
    raise ValueError(f"form must be 'keyed' or 'positional', not {form!r}")


def word_polarity(lexicon: DataFrame, word: str) -> DataFrame:
    """The polarity of one word as a one-row table, empty when the word is not listed."""
    hits = lexicon.filter(F.col("word") == word)
    return hits.agg(F.concat_ws(" ", F.collect_list("polarity")).alias("polarity"))
