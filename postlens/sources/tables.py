"""Token tables written by the tokenize stream."""

from pyspark.sql import DataFrame, SparkSession


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the folder itself, never a glob below it.

    The folder holds the sink's commit log, so files of unfinished or repeated
    attempts are not counted. A glob bypasses the log.
    """
    return spark.read.parquet(path)
