"""Consecutive line numbers over a table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sizing import Size, fits_broadcast
from ..workspace import new_folder

# monotonically_increasing_id: partition number above this bit, row number below it.
_ROW_BITS = 33


def number_lines(
    lines: DataFrame, order_by: str | Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add `line_no` (from 1, in the order of `order_by`) and `line_count`.

    `order_by` must be unique as a whole, or lines with equal keys swap places.

    The lines are sorted into ranges and written to the shared folder with their
    place in the range. Only then are the ranges counted, so that both passes see
    the same ranges, also after the loss of an executor. What is summed up and
    broadcast is one row per range: `ranges`, or else at most
    `spark.sql.shuffle.partitions`.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    spark = lines.sparkSession
    folder = new_folder(spark, "numbered")
    (
        lines.repartitionByRange(*([] if ranges is None else [ranges]), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .write.parquet(folder)
    )
    placed = spark.read.parquet(folder)
    ranged = placed.select(
        *lines.columns,
        F.shiftright("_place", _ROW_BITS).alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_lines"))
    everything = Window.partitionBy()
    before = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.sum("_lines").over(everything).alias("line_count"),
    )
    return ranged.join(F.broadcast(offsets), "_range").select(
        *lines.columns, (F.col("_before") + F.col("_row") + 1).alias("line_no"), "line_count"
    )


def number_text(spark: SparkSession, path: str) -> DataFrame:
    """`value, line_no, line_count` of the lines of text files, in order of file and line.

    Nothing is sorted and no line is shuffled or written. A first scan counts the lines of
    every input split; sums over the splits, in order of their files and offsets, say how
    many lines come before each. The second scan adds a line's place in its split. A split
    is known by its task, file, offset and length, and a scan whose splits are not those
    that were counted is an error, so files must not change meanwhile.

    What is broadcast is 48 bytes per split, if that fits; beyond that the lines are joined
    with the sums by a shuffle. Lines are numbered from 1.
    """
    meta = F.col("_metadata")
    split = F.xxhash64(meta["file_path"], meta["file_block_start"], meta["file_block_length"], F.lit(0))
    again = F.xxhash64(meta["file_path"], meta["file_block_start"], meta["file_block_length"], F.lit(1))
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        "value",
        meta["file_path"].alias("_file"),
        meta["file_block_start"].alias("_block"),
        F.struct(split.alias("a"), again.alias("b")).alias("_split"),
        F.shiftright(place, _ROW_BITS).alias("_task"),
        place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    folder = new_folder(spark, "splits")
    lines.groupBy("_task", "_file", "_block", "_split").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first")
    ).write.parquet(folder)
    splits = spark.read.parquet(folder)
    everything = Window.partitionBy()
    before = everything.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = splits.select(
        F.col("_task").alias("_of_task"),
        F.col("_split").alias("_of_split"),
        "_lines",
        "_first",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.sum("_lines").over(everything).alias("line_count"),
    )
    number = splits.count()
    sums = F.broadcast(sums) if fits_broadcast(Size(number, 48 * number)) else sums
    on = (F.col("_task") == F.col("_of_task")) & (F.col("_split") == F.col("_of_split"))
    inside = F.col("_row") - F.col("_first")
    counted = (inside >= 0) & (inside < F.col("_lines"))
    line_no = F.when(counted, F.col("_before") + inside + 1).otherwise(
        F.raise_error(F.lit("the splits of the text are not those that were counted")).cast("bigint")
    )
    return lines.join(sums, on, "left").select("value", line_no.alias("line_no"), "line_count")
