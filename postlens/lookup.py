"""Tables that rows look themselves up in without a join: dense arrays, and Bloom filters.

A dense table is one row that holds an array of arrays. An expression reads it as a scalar
subquery, so it is sent to the tasks once, appears in no plan text, and a look-up stays
inside generated code. The caller bounds its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import new_folder

# Numbers of one inner array.
SLICE = 1 << 16

# Bits of a Bloom filter for each of its keys, and bits that a key sets: about 1% pass wrongly.
BITS = 10
PROBES = 5

# What a Bloom filter may take; with fewer than `LEAST_BITS` for a key it is not worth it.
FILTER_BYTES = 64 * 1024 * 1024
LEAST_BITS = 4


def dense(values: DataFrame, value: str, size: int, empty: int) -> DataFrame:
    """One row `table`: the `value` of each `place` from 0 to `size` - 1, `empty` without one.

    `size` is a power of two; places are different and not NULL. Arrays are of the type of
    `value`.
    """
    spark, kind = values.sparkSession, values.schema[value].dataType
    width = min(SLICE, size)
    found = values.groupBy(F.expr(f"place div {width}").alias("slice")).agg(
        F.array_sort(F.collect_list(F.struct(F.expr(f"place % {width}").cast("int").alias("at"), value))).alias("v")
    )
    fill = lambda n: F.array_repeat(F.lit(empty).cast(kind), n)
    v = F.col("v")
    before = lambda i: F.coalesce(F.get(v, i - 1)["at"], F.lit(-1))
    runs = F.transform(v, lambda x, i: F.concat(fill(x["at"] - before(i) - 1), F.array(x[value])))
    last = F.coalesce(F.element_at(v, -1)["at"], F.lit(-1))
    filled = F.concat(F.flatten(runs), fill(F.lit(width - 1) - last))
    every = spark.range(size // width).withColumnRenamed("id", "slice")
    rows = every.join(found, "slice", "left").select(
        F.struct("slice", F.when(v.isNull(), fill(F.lit(width))).otherwise(filled).alias("values")).alias("row")
    )
    rows = rows.agg(F.array_sort(F.collect_list("row")).alias("rows"))
    folder = new_folder(spark, "dense")
    rows.select(F.transform("rows", lambda r: r["values"]).alias("table")).write.parquet(folder)
    return spark.read.parquet(folder)


def look_up(table: DataFrame, place: Column, size: int) -> Column:
    """The value at a place of a table of `dense`. Not for use within a lambda."""
    width = min(SLICE, size)
    outer = F.shiftright(place, width.bit_length() - 1).cast("int")
    return F.get(F.get(table.scalar(), outer), (place % width).cast("int"))


class Bloom:
    """Tells most keys that are not among the given ones; those given always pass."""

    def __init__(self, table: DataFrame, size: int) -> None:
        self.table, self.size = table, size

    def passes(self, key: Column) -> Column:
        found = F.lit(True)
        for place, bit in _bits(key, self.size):
            word = F.call_function("shiftright", look_up(self.table, place, self.size), bit)
            found &= word.bitwiseAND(F.lit(1)) == 1
        return found


def _bits(key: Column, size: int) -> list[tuple[Column, Column]]:
    """Places of 64-bit words, and bits in them, that a key sets in a filter of `size` words."""
    hashes = [F.xxhash64(key, F.lit(probe)) for probe in range(PROBES)]
    return [
        (F.pmod(F.shiftright(h, 6), F.lit(size).cast("bigint")), h.bitwiseAND(F.lit(63)).cast("int"))
        for h in hashes
    ]


def bloom(keys: DataFrame, key: str, count: int) -> Bloom | None:
    """A filter of `count` keys or fewer; None if they are too many for `FILTER_BYTES`.

    Made by one shuffle of the words that are set, which are combined before it.
    """
    most = FILTER_BYTES // 8
    size = 1 << max(0, (max(count, 1) * BITS - 1) // 64).bit_length()
    if size > most:
        size = 1 << (most.bit_length() - 1)
    if size * 64 < count * LEAST_BITS:
        return None
    set_bits = F.explode(F.array(*(F.struct(p.alias("place"), b.alias("bit")) for p, b in _bits(F.col(key), size))))
    words = keys.select(set_bits.alias("x")).groupBy("x.place").agg(
        F.bit_or(F.expr("shiftleft(1L, x.bit)")).alias("word")
    )
    return Bloom(dense(words, "word", size, 0), size)
