"""Labels for every micro-batch of a token stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sentiment import Lookup, label_tokens, prepare_lexicon
from ..schemas import LABELS
from .batches import published, read_batches, write_batch
from .owner import claim


def start_labels(
    tokens: DataFrame,
    lexicon: DataFrame | Lookup,
    path: str,
    checkpoint: str,
    edges: str = "clean",
    available_now: bool = False,
) -> StreamingQuery:
    """Append labels to `path`, those of each post exactly once.

    No state is kept between batches: the tokens of a post are all in its row. The lexicon
    is read once, when the stream starts. Under the row plan labels are a projection and go
    through the Parquet sink with its commit log. Under a join plan each batch is published
    in two phases (see `batches`). Either way readers see whole batches only.

    A folder belongs to one stream. Batches are told apart by numbers that a checkpoint
    counts, so another checkpoint, a new one in the place of the old, or the other kind of
    plan would leave out labels or give them twice; each of them is an error.
    """
    spark = tokens.sparkSession
    lookup = prepare_lexicon(lexicon)
    claim(spark, path, checkpoint, "row" if lookup.strategy == "row" else "join", lambda: _has_labels(spark, path))
    if lookup.strategy == "row":
        writer = label_tokens(tokens, lookup, edges=edges).writeStream.format("parquet")
        writer = writer.outputMode("append").option("path", path)
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            write_batch(label_tokens(batch, lookup, edges=edges), path, batch_id)

        writer = tokens.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _has_labels(spark: SparkSession, path: str) -> bool:
    try:
        return not read_labels(spark, path).isEmpty()
    except AnalysisException:
        return False


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """`id`, `score` and `label` of all batches that are published or committed by now."""
    if published(spark, path) is None:
        return spark.read.parquet(path)
    return read_batches(spark, path, LABELS).drop("batch_id")
