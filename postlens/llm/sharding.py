"""Shards by fixed virtual slots.

A record's hash names one of a fixed number of virtual slots. Bytes are added up per
slot, and a slot map, one row per slot, says which shard a slot lies in. The map is
stored by version; rebalancing writes a further version in which few slots change.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlens.llm.common import free_name

SLOTS = 8192
PARTS = 16  # numbering groups of a slot

MAP = T.StructType(
    [
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
    ]
)


def record_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def virtual_slot(hashed: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, size: str = "size", slots: int = SLOTS) -> dict[int, int]:
    """Bytes per slot; at most `slots` rows come to the driver."""
    rows = records.groupBy("virtual_slot").agg(F.sum(size).alias("bytes")).collect()
    return {slot: 0 for slot in range(slots)} | {row["virtual_slot"]: row["bytes"] for row in rows}


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slots by falling size, each to the shard that holds least. Empty slots count as one byte."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        held, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (held + max(sizes[slot], 1), shard))
    return placed


def edited_map(
    placed: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.02
) -> dict[int, int]:
    """A map for new sizes or a new number of shards that moves few slots.

    Slots of shards that no longer exist move, as do the largest fitting slots of a shard
    that holds more than `1 + slack` times the mean; all others stay. A moved slot goes to
    the shard that holds least.
    """
    held = dict.fromkeys(range(shards), 0)
    for slot, shard in placed.items():
        if shard in held:
            held[shard] += sizes[slot]
    mean = sum(sizes.values()) / shards
    moving = [slot for slot, shard in placed.items() if shard not in held]
    for shard in range(shards):
        for slot in sorted((s for s, at in placed.items() if at == shard), key=lambda s: (-sizes[s], s)):
            if held[shard] <= mean * (1 + slack):
                break
            if sizes[slot] and held[shard] - sizes[slot] >= mean * (1 - slack):
                held[shard] -= sizes[slot]
                moving.append(slot)
    placed = dict(placed)
    for slot in sorted(moving, key=lambda s: (-sizes[s], s)):
        shard = min(held, key=lambda s: (held[s], s))
        held[shard] += sizes[slot]
        placed[slot] = shard
    return placed


def save_map(
    spark: SparkSession, folder: str, version: int, placed: dict[int, int], sizes: dict[int, int]
) -> None:
    """Write one version of the map; a version that exists is an error, never replaced."""
    rows = [(slot, shard, sizes[slot]) for slot, shard in sorted(placed.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(
        f"{folder}/version={version:06d}"
    )


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{folder}/version={version:06d}")


def with_slots(records: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds `virtual_slot`, and a division of the slot for numbering."""
    hashed = record_hash(*(F.col(key) for key in keys))
    return records.withColumns(
        {
            "virtual_slot": virtual_slot(hashed, slots),
            PART: F.pmod(F.shiftright(hashed, 40), F.lit(PARTS)).cast("int"),
        }
    )


# A column that `place` takes away again.
PART = "_slot_part"


def place(records: DataFrame, placed: DataFrame, order: list[str]) -> DataFrame:
    """Adds `shard` and `slot`, the row's gapless number from 0 within its shard.

    Rows are numbered within (virtual slot, part), by `order`; the counts of these groups,
    a fixed number of rows, give each group its offset in the shard.
    """
    offset, within = free_name(records, "_slot_offset"), free_name(records, "_slot_within")
    records = records.join(F.broadcast(placed.select("virtual_slot", "shard")), "virtual_slot")
    group = ["shard", "virtual_slot", PART]
    counts = records.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", PART)
    before = F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, F.coalesce(before, F.lit(0)).alias(offset))
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return (
        records.withColumn(within, number)
        .join(F.broadcast(offsets), group)
        .withColumn("slot", (F.col(offset) + F.col(within)).cast("bigint"))
        .drop(PART, within, offset)
    )


def shard_records(
    records: DataFrame,
    folder: str,
    shards: int,
    keys: list[str],
    size: str = "size",
    slots: int = SLOTS,
) -> DataFrame:
    """Adds `virtual_slot`, `shard` and `slot` to every row, after storing map version 1.

    Shards come out near equal in bytes, as far as single slots allow. Rows with equal
    `keys` share a slot; NULL keys are hashed like any value. Sizes must not be NULL. An
    empty table gives an empty table and a map of empty slots. Columns named like the new
    ones are replaced.
    """
    spark = records.sparkSession
    records = records.drop("virtual_slot", "shard", "slot", PART)
    records = with_slots(records, keys, slots)
    sizes = slot_bytes(records, size, slots)
    save_map(spark, folder, 1, first_map(sizes, shards), sizes)
    return place(records, load_map(spark, folder, 1), [*keys, size])
