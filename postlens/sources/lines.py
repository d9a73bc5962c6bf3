"""JSON lines: landed stream payloads, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from ..functions import tokens_nw
from ..schemas import STREAM_LINE


def sample_file(spark: SparkSession, path: str) -> str:
    """One landed file with at least one line. Reading stops at the first line."""
    return spark.read.text(path).select("_metadata.file_path").first().file_path


def infer_schema(spark: SparkSession, sample_path: str) -> StructType:
    """The schema of a sample (one landed file), to be reused for the rest."""
    return spark.read.json(sample_path).schema


def read_lines(spark: SparkSession, path: str, schema: StructType = STREAM_LINE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_lines(
    spark: SparkSession,
    path: str,
    schema: StructType = STREAM_LINE,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """The same folder as a stream, in micro-batches of bounded size (see `bounded`)."""
    return bounded(spark.readStream.schema(schema), max_files, max_bytes).json(path)


def bounded(
    reader: DataStreamReader, max_files: int | None = None, max_bytes: int | None = None
) -> DataStreamReader:
    """A reader of files whose micro-batches take at most so many files, or so many bytes.

    Bytes take the place of files if both are given. A file is never split between batches,
    so a single larger one makes a batch of its own.
    """
    if max_bytes is not None:
        return reader.option("maxBytesPerTrigger", max_bytes)
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def token_rows(lines: DataFrame, keep_corrupt: bool = False) -> DataFrame:
    """`id` and the tokens of the text for every line; works on batches and streams alike.

    A line that is no JSON object, or has no `data`, is no post and is left out;
    `keep_corrupt` keeps it as a row of NULLs, which is labelled mixed later on.
    """
    if not keep_corrupt:
        lines = lines.filter(F.col("data").isNotNull())
    return lines.select(
        F.col("data.id").alias("id"), tokens_nw(F.col("data.text")).alias("text")
    )
