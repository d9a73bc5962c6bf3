"""A small synthetic lexicon, for the registered queries and the tests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The words of the sample lexicon in file order, by polarity.
WORDS = (
    ("positive", "good happy is that for la with by are und ble tion widget hot PROMO"),
    ("negative", "bad awful of was on der en it from que th rod cold SMALL"),
    ("neutral", "in calm Von. ECONOMY"),
    ("both", "to mood MEDIUM"),
    ("positive", "as"),
    ("negative", "as this"),
    ("positive", "this like"),
    ("negative", "like"),
)

# Two irregular lines, one with a seventh field and one without a polarity.
IRREGULAR = (
    "type=strongsubj len=1 word1=odd pos1=adj stemmed1=n m priorpolarity=negative",
    "type=weaksubj len=1 word1=short",
)


def sample_lines() -> list[str]:
    regular = [
        f"type=weaksubj len=1 word1={word} pos1=adj stemmed1=n priorpolarity={polarity}"
        for polarity, words in WORDS
        for word in words.split(" ")
    ]
    return [*regular, *IRREGULAR]


def sample_raw(spark: SparkSession) -> DataFrame:
    """The lines with their number, as `parse_keyed` takes them."""
    lines = sample_lines()
    return spark.createDataFrame(
        pa.table({"ord": pa.array(range(1, len(lines) + 1), pa.int64()), "value": lines})
    )


def sample_fields(spark: SparkSession) -> DataFrame:
    """The same lines cut at spaces, as `parse_positional` takes them."""
    rows = [line.split(" ") for line in sample_lines()]

    def at(i: int) -> pa.Array:
        return pa.array([row[i] if i < len(row) else None for row in rows], pa.string())

    return spark.createDataFrame(
        pa.table(
            {
                "ord": pa.array(range(1, len(rows) + 1), pa.int64()),
                "word": at(2),
                "sentiment": at(5),
            }
        )
    )
