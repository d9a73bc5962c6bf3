"""Landed lines to tokens of ruled accounts, with what was turned away beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tokens_nw
from ..operators.rules import match_rules
from ..schemas import ACCOUNT_LINE, BATCH_COUNTS, REJECTED, RULED_TOKENS, RULES
from .batches import ROWS, first_line, is_published, published, read_batches, write_batch, write_line
from .owner import claim

# Which version of the rules each batch goes by.
VERSIONS = "_rules"


def add_rules(rules: DataFrame, path: str) -> int:
    """Make these the rules in force from now on, as a further version, and return its number.

    Earlier versions stay, for batches that began under them.
    """
    spark = rules.sparkSession
    version = max(published(spark, path) or {0: ""}) + 1
    write_batch(rules.select(RULES.names), path, version)
    return version


def rules_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rules of one version."""
    folder = (published(spark, path) or {}).get(version)
    if folder is None:
        raise ValueError(f"{path} holds no version {version} of the rules")
    return spark.read.schema(RULES).parquet(f"{path}/{folder}/{ROWS}")


def start_checked_tokens(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    rules: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Publish, for every micro-batch of text lines, its tokens and the lines that are no posts.

    A line is a post if it is a JSON object with `data`; any other is kept as it came, in the
    table of rejected lines, and counted. With `rules`, a folder of `add_rules`, only posts
    are tokenized whose account a rule names, once per rule, with its tag. Each batch reads
    the rules anew and notes their version before it writes anything, so a batch that is
    repeated goes by the same rules as before, also if they have changed since.

    The lines of a batch are read once for each of its three tables. Readers see whole
    batches (see `batches`); the folder is one stream's.
    """
    spark = lines.sparkSession
    claim(spark, path, checkpoint, "checked", lambda: bool(published(spark, path)))

    def write(batch: DataFrame, batch_id: int) -> None:
        if is_published(spark, path, batch_id):
            return
        version = None if rules is None else _version_of(spark, path, batch_id, rules)
        parsed = batch.select("value", F.from_json("value", ACCOUNT_LINE).getField("data").alias("data"))
        bad = F.col("data").isNull()
        posts = parsed.where(~bad).select("data.*").withColumn("tag", F.lit(None).cast("string"))
        if version is not None:
            posts = match_rules(posts.drop("tag"), rules_version(spark, rules, version))
        tokens = posts.select("id", tokens_nw(F.col("text")).alias("text"), "account", "tag")
        counts = parsed.agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(bad).alias("n_rejected"),
            F.lit(version).cast("bigint").alias("rules_version"),
        )
        tables = {"tokens": tokens, "rejected": parsed.where(bad).select("value"), "counts": counts}
        write_batch(tables, path, batch_id)

    writer = lines.select("value").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _version_of(spark: SparkSession, path: str, batch_id: int, rules: str) -> int:
    """The version that this batch went by before, or else the latest one from now on."""
    note = f"{path}/{VERSIONS}/batch-{batch_id}"
    known = first_line(spark, note)
    if known is not None:
        return int(known)
    versions = published(spark, rules)
    if not versions:
        raise ValueError(f"{rules} holds no rules")
    write_line(spark, note, str(max(versions)))
    return max(versions)


def read_checked_tokens(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, RULED_TOKENS, "tokens")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, REJECTED, "rejected")


def read_batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """`n_lines`, `n_rejected` and `rules_version` of every batch."""
    return read_batches(spark, path, BATCH_COUNTS, "counts")
