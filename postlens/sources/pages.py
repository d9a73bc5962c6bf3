"""Paged search responses.

All stored pages are one source: the chain of `next_token`s decides which pages
exist, not how their posts combine, so nothing has to follow it at query time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import PAGE

CORRUPT = "_corrupt"


def read_pages(
    spark: SparkSession,
    path: str,
    schema: StructType = PAGE,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Pages stored as JSON, one per line, or one per file with `multi_line`.

    A page that is no whole JSON is an error. With ``PERMISSIVE`` it has no posts, and
    `page_counts` tells how many such pages there are.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", mode).json(path)


def page_counts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row: `n_pages`, `n_corrupt` of them, `n_posts`, and `n_last`, pages that name no next.

    A complete chain of pages has one last page.
    """
    schema = StructType([*PAGE.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    pages = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    whole = F.col(CORRUPT).isNull()
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count(CORRUPT).alias("n_corrupt"),
        F.coalesce(F.sum(F.when(whole, F.array_size("data"))), F.lit(0)).alias("n_posts"),
        F.count(F.when(whole & ~has_next(), True)).alias("n_last"),
    )


def parse_pages(documents: DataFrame, column: str = "value", schema: StructType = PAGE) -> DataFrame:
    """Pages held as JSON strings. The other columns of the row stay beside `data` and `meta`."""
    parsed = documents.withColumn("_page", F.from_json(column, schema))
    return parsed.select(*[c for c in documents.columns if c != column], "_page.*")


def page_posts(pages: DataFrame) -> DataFrame:
    """One row per post, its fields as columns. A page without hits gives no rows."""
    return pages.select(F.explode("data").alias("post")).select("post.*")


def has_next(page_meta: str = "meta") -> Column:
    return F.col(f"{page_meta}.next_token").isNotNull()


def union_posts(*frames: DataFrame) -> DataFrame:
    """All posts of frames with different fields, matched by name. Copies are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
