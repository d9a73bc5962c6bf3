"""Landed JSON lines to a Parquet token table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TOKEN_ROWS
from ..sources.lines import bounded


def start_tokens(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    row_group_bytes: int | None = None,
) -> StreamingQuery:
    """Append token rows to `path`, each exactly once.

    `row_group_bytes` is for readers that want small row groups. Left alone, the
    writer's default suits large scans.
    """
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    if row_group_bytes is None:
        return writer.start()
    with _session_setting(rows.sparkSession, "parquet.block.size", row_group_bytes):
        return writer.start()


@contextmanager
def _session_setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """Set a writer property while a stream starts.

    The streaming file sink takes such properties from the session, once, when the
    query starts. Options of the stream do not reach the writer.
    """
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def session_with(spark: SparkSession, settings: dict[str, object]) -> SparkSession:
    """A session with the settings this one has now and some of its own."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name, str(value))
    return own


def stream_tokens(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """A token table as a stream of its own."""
    return bounded(spark.readStream.schema(TOKEN_ROWS), max_files, max_bytes).parquet(path)
