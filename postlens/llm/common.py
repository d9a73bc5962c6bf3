"""What several operators share: words, hidden column names, Python workers' import path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters between words.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; a NULL text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_prefix(df: DataFrame, prefix: str = "_") -> str:
    """A prefix that no column name of `df` begins with, whatever the case."""
    while any(column.lower().startswith(prefix.lower()) for column in df.columns):
        prefix += "_"
    return prefix


def importable(spark: SparkSession) -> None:
    """Let Python workers of this application find this package where the driver found it.

    It changes nothing where the package was shipped with the job or is on the path.
    """
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))


def document_rows(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
