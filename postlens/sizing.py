"""Size checks that decide between plans: what may be broadcast, what must be spread."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What every executor may hold a copy of.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Scans of more splits than this are never spread: 8 GiB at the default split size.
SPREAD_SPLITS = 64

# Parts made of one split when it is spread, 4 MiB each at the default split size.
PARTS_PER_SPLIT = 32

# Keys that are split at most when neither side can be broadcast, and what the sketch that
# finds them keeps track of.
HOT_KEYS = 1_000
TRACKED = 20_000

# What one shuffle partition of a table may take for a hash join to build on it.
BUILD_BYTES = 4 * 1024 * 1024


class Size(NamedTuple):
    rows: int
    bytes: int


def measure(df: DataFrame) -> Size:
    """Rows and text bytes of a table, by one aggregate that never gathers the rows."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        fixed = field.dataType.typeName() != "string"
        width += F.lit(16) if fixed else F.coalesce(F.octet_length(field.name), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return Size(row["n"], row["b"] or 0)


def fits_broadcast(size: Size) -> bool:
    return size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES


def hot_keys(facts: DataFrame, on: str) -> dict[str, int]:
    """Keys that alone have more rows than a shuffle partition should, and parts to split each into.

    Measured by a frequent-items sketch, which every task makes for itself before they are
    merged; no rows are shuffled. The share above which a key is hot is that of one of the
    session's shuffle partitions, but at least one in `HOT_KEYS`, so there are no more of
    them. The sketch counts too high by at most the rows over `TRACKED`, a fraction of that
    share. Which keys are found changes the plan only, not what is joined.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(partitions, HOT_KEYS))
    row = facts.select(F.col(on).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {partitions}, {TRACKED})").alias("top")
    ).first()
    share = row["n"] / partitions
    found = {x["item"]: -(-x["count"] // max(1, int(share))) for x in row["top"] or () if x["item"] is not None}
    return {key: parts for key, parts in found.items() if parts > 1}


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    how: str,
    spread_by: list[Column],
    hot: dict[str, int] | None = None,
    dim_bytes: int | None = None,
) -> DataFrame:
    """Shuffle join that splits the hot keys of `facts`, each into parts by its share.

    `hot` is what `hot_keys` finds, which is asked if it is not given. Only their rows of
    `dim` are repeated, once per part. The salt is a hash of row values, not a random
    number, so a task that is run again sends its rows to the same places. `dim` is known
    not to fit a broadcast. If `dim_bytes`, its measured size, is given and comes to little
    for a shuffle partition, a hash join builds on it and the facts need not be sorted; else
    the sort-merge join, which can spill, is asked for.
    """
    hot = hot_keys(facts, on) if hot is None else hot
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = dim_bytes is not None and dim_bytes <= BUILD_BYTES * partitions
    hint = "shuffle_hash" if small else "merge"
    if not hot:
        return facts.join(dim.hint(hint), on, how)
    kind = facts.schema[on].dataType.simpleString()
    parts = facts.sparkSession.createDataFrame(list(hot.items()), f"`{on}` {kind}, _parts int")
    parts = F.broadcast(parts)
    spread_to = F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = facts.join(parts, on, "left").withColumn("_salt", spread_to).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    repeated = dim.join(parts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(repeated.drop("_parts").hint(hint), [on, "_salt"], how).drop("_salt")


def spread(scan: DataFrame) -> DataFrame:
    """Use more cores when a scan has fewer splits than half of them.

    A table of one small file gives few splits, and with them few busy cores. Larger
    tables are returned as they are, without a shuffle. Apply it to a pruned scan,
    before any expensive expression.
    """
    if scan.isStreaming:
        return scan
    slots = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    if splits > SPREAD_SPLITS or splits * 2 > slots:
        return scan
    return scan.repartition(min(slots, max(splits, 1) * PARTS_PER_SPLIT))
