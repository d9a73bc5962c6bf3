"""A report that follows the token stream: label counts kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import label_counts, share_report
from ..operators.sentiment import Lookup, label_tokens, prepare_lexicon
from ..schemas import COUNTS
from .batches import is_published, published, read_batches, write_batch
from .owner import claim


def start_report(
    tokens: DataFrame,
    lexicon: DataFrame | Lookup,
    path: str,
    checkpoint: str,
    edges: str = "clean",
    available_now: bool = False,
) -> StreamingQuery:
    """Publish the counts of all labels so far after every micro-batch.

    The counts are a streaming aggregate in the state store: one row per label, which the
    checkpoint keeps, so a batch reads its own posts only, however many there were before,
    and a restart goes on where the last batch ended. Counts are added up in the tasks that
    read the posts. The lexicon is read once and must fit the row plan: under a join plan
    the labels of a batch are themselves an aggregate, which cannot be followed by another
    in one stream.

    Readers see the report of a whole batch (see `batches`); the folder is one stream's.
    """
    spark = tokens.sparkSession
    lookup = prepare_lexicon(lexicon)
    if lookup.strategy != "row":
        raise ValueError(f"a running report needs a lexicon for the row plan, not {lookup.strategy}")
    claim(spark, path, checkpoint, "report", lambda: bool(published(spark, path)))
    counts = label_counts(label_tokens(tokens, lookup, edges=edges))

    def write(report: DataFrame, batch_id: int) -> None:
        if is_published(spark, path, batch_id):
            # A repeated batch must still bring the state store to its version.
            report.write.format("noop").mode("overwrite").save()
        else:
            write_batch(report.coalesce(1), path, batch_id)

    writer = counts.writeStream.outputMode("complete").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_report(spark: SparkSession, path: str, order: str = "share") -> DataFrame:
    """The share report of the last published batch; no rows before the first."""
    return share_report(read_batches(spark, path, COUNTS, last=True), order)
