"""Connected components by alternating stars, over any orderable node type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.workspace import new_folder


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `a, b`; the root is the least node it reaches.

    Each round links the greater neighbours of a node to its least one, then all smaller
    neighbours, until every component is a star. A node of very many edges is only ever
    joined with one row of its own, and its edges are combined before they are shuffled.
    Every round's edges, no more than there were at first, are written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges, known = _written(edges, spark), None
    while True:
        seen = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        known = seen
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _written(small.union(least).distinct(), spark)


def _written(edges: DataFrame, spark) -> DataFrame:
    folder = new_folder(spark, "edges")
    edges.write.parquet(folder)
    return spark.read.parquet(folder)
