"""Folders whose micro-batches readers see whole.

A batch is published in two phases. Its tables are written to a folder of their own, then
one line that names the folder is written to the manifest. Readers take only what the
manifest names. The line is a file that appears when its write is committed, so at any
time a batch is there with all its rows or not at all; the folder of an attempt that was
stopped before is never read. A batch that is published is not written again: a stream
that repeats it, after its checkpoint lost the commit, leaves the published one in force.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest"

# The table of a batch that has only one.
ROWS = "rows"


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a small file or folder, None if there is none."""
    try:
        head = spark.read.text(path).limit(1).collect()
    except AnalysisException:
        return None
    return head[0].value if head else None


def write_line(spark: SparkSession, path: str, line: str) -> None:
    """One line as a file that readers see when its write is committed.

    What is there without a line, of an attempt that was stopped, is replaced.
    """
    text = spark.range(1).selectExpr(f"CAST(X'{line.encode().hex()}' AS STRING) AS value")
    text.coalesce(1).write.mode("overwrite").text(path)


def is_published(spark: SparkSession, path: str, batch_id: int) -> bool:
    return first_line(spark, f"{path}/{MANIFEST}/batch-{batch_id}") is not None


def write_batch(tables: DataFrame | Mapping[str, DataFrame], path: str, batch_id: int) -> None:
    """Write and publish the tables of a batch, unless it is published already."""
    tables = {ROWS: tables} if isinstance(tables, DataFrame) else tables
    spark = next(iter(tables.values())).sparkSession
    if is_published(spark, path, batch_id):
        return
    folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{folder}/{name}")
    publish(spark, path, batch_id, folder)


def publish(spark: SparkSession, path: str, batch_id: int, folder: str) -> None:
    """The second phase: from here on readers see the batch."""
    write_line(spark, f"{path}/{MANIFEST}/batch-{batch_id}", f"{batch_id} {folder}")


def published(spark: SparkSession, path: str) -> dict[int, str] | None:
    """Folders of the published batches by number; None if `path` has no manifest."""
    try:
        lines = spark.read.text(f"{path}/{MANIFEST}/batch-*").collect()
    except AnalysisException:
        return None
    return {int(number): folder for number, folder in (row.value.split(" ") for row in lines)}


def read_batches(
    spark: SparkSession, path: str, schema: StructType, table: str = ROWS, last: bool = False
) -> DataFrame:
    """The rows of all published batches, or of the last one, with `batch_id`.

    The manifest is read once, here: batches published later are not seen by this table.
    """
    found = published(spark, path) or {}
    numbers = [max(found)] if last and found else sorted(found)
    if not numbers:
        return spark.createDataFrame([], StructType([*schema.fields]).add("batch_id", "long"))
    folders = [f"{path}/{found[number]}/{table}" for number in numbers]
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)-[0-9a-f]{32}/", 1)
    return spark.read.schema(schema).parquet(*folders).select(*schema.names, number.cast("bigint").alias("batch_id"))
