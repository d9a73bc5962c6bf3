"""List ranking: how much lies before every element of a linked list spread over a cluster.

Elements are spliced out by coin flips until few are left: an element goes if its coin
shows one and that of the element before it shows zero, so no two neighbours go at once and
about a quarter goes each round. Those left are walked, and the rounds are undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import importable
from postlens.workspace import new_folder

# Links that one task walks at the end, whatever the length of the list.
BASE = 2048


def _walked(table):
    import pyarrow as pa

    ids = table.column("id").to_pylist()
    links = dict(zip(ids, zip(table.column("next").to_pylist(), table.column("weight").to_pylist(), strict=True), strict=True))
    found, ranks = [], []
    for at in links.keys() - {after for after, _ in links.values()}:
        rank = 0
        while at is not None:
            found.append(at)
            ranks.append(rank)
            at, weight = links.get(at, (None, 0))
            rank += weight
    return pa.table([pa.array(found, pa.binary()), pa.array(ranks, pa.int64())], ["id", "rank"])


def list_ranks(links: DataFrame, base: int = BASE) -> DataFrame:
    """`id, rank` for `links`: `id` (binary), `next`, `weight`; the weights before each element.

    An element whose `next` is NULL ends its list. There may be several lists; each starts
    at 0. Ids are not NULL, every id has one row and is the next of at most one. Elements of
    a ring have no rank. Every round's links, three quarters of those before, are written to
    the shared folder.
    """
    spark = links.sparkSession
    importable(spark)

    def written(rows: DataFrame) -> DataFrame:
        folder = new_folder(spark, "list")
        rows.write.parquet(folder)
        folders.append(folder)
        return spark.read.parquet(folder)

    folders: list[str] = []
    current, removed = written(links.select("id", "next", "weight")), []
    while current.where("next IS NOT NULL").count() > base:
        coin = F.pmod(F.xxhash64("id", F.lit(len(removed))), F.lit(2))
        zero = current.where(coin == 0)
        one = current.where(coin == 1).toDF("_id", "_next", "_weight")
        both = F.col("id").isNotNull() & F.col("_id").isNotNull()
        spliced = zero.join(one, F.col("next") == F.col("_id"), "full_outer").select(
            F.coalesce("id", "_id").alias("id"),
            F.when(both, F.col("_next")).otherwise(F.coalesce("next", "_next")).alias("next"),
            (F.coalesce("weight", F.lit(0)) + F.coalesce("_weight", F.lit(0))).alias("weight"),
            F.when(both, F.col("_id")).alias("gone"),
            F.when(both, F.col("weight")).alias("before"),
        )
        spliced = written(spliced)
        removed.append(spliced.where("gone IS NOT NULL").select("gone", F.col("id").alias("anchor"), "before"))
        current = spliced.select("id", "next", "weight")
    few = current.where("next IS NOT NULL").groupBy(F.lit(0).alias("all"))
    folders.clear()
    written(few.applyInArrow(_walked, "id binary, rank bigint"))
    touched = current.where("next IS NOT NULL")
    touched = touched.select("id").union(touched.select("next"))
    written(current.join(touched, "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("rank")))
    for gone in reversed(removed):
        ranks = spark.read.parquet(*folders)
        placed = gone.join(ranks, F.col("anchor") == F.col("id"))
        written(placed.select(F.col("gone").alias("id"), (F.col("rank") + F.col("before")).alias("rank")))
    return spark.read.parquet(*folders)
