"""A stream of text lines to small landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.landing import LINES_PER_FILE


def start_landing(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    per_file: int = LINES_PER_FILE,
    available_now: bool = False,
) -> StreamingQuery:
    """Land every line once, in files of at most `per_file` lines.

    Batches are as large as the source of `lines` makes them.

    Readers of the folder see a file once its micro-batch is committed. Unlike
    `land_lines` no line waits for the next one: the end of a micro-batch is landed
    in a shorter file.
    """
    writer = (
        lines.writeStream.format("text")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", per_file)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
