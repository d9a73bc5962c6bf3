"""Landing files of a fixed number of lines.

Line n belongs to file n // per_file + 1, so the first file is one line short. A
file is published once the line after its last one has been seen; the lines of
the unfinished last file are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_PER_FILE = 10


def roll_files(numbered: DataFrame, per_file: int = LINES_PER_FILE) -> DataFrame:
    """Add `file_no` and `published` to the lines of `number_lines`."""
    return numbered.withColumn("file_no", F.expr(f"line_no div {per_file} + 1")).withColumn(
        "published", F.expr(f"file_no <= line_count div {per_file}")
    )


def file_summary(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("file_no", "published").agg(F.count(F.lit(1)).alias("n_lines"))


def land_lines(rolled: DataFrame, path: str, value: str = "value") -> None:
    """Write the published files, one ``file_no=<k>`` folder each, lines in order.

    Readers see a file only after the write has been committed. Landing twice on
    one path is an error.
    """
    (
        rolled.filter("published")
        .select(F.col(value).alias("value"), "file_no", "line_no")
        .repartition("file_no")
        .sortWithinPartitions("file_no", "line_no")
        .select("value", "file_no")
        .write.partitionBy("file_no")
        .text(path)
    )


def land_chunks(lines: DataFrame, path: str, per_file: int = LINES_PER_FILE, value: str = "value") -> None:
    """Write every line into files of at most `per_file` lines, in one pass without a shuffle."""
    lines.select(F.col(value).alias("value")).write.option("maxRecordsPerFile", per_file).text(path)
