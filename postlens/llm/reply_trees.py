"""Root-to-leaf paths of reply trees, by iterated self-joins.

A pointer from every node to its parent is doubled: joined with itself, the pointers over
2^k steps give those over 2^(k+1), so a tree of depth d takes log2(d) joins. Sums of scores
go along, and the best leaves of a tree are chosen by them. The chosen paths are then laid
out downwards through the same pointers: a stretch of more than 2^k nodes is cut into its
lower 2^k nodes and the rest above. Rows laid out are as many as the paths have nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.workspace import new_folder


def _written(rows: DataFrame, name: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables of `tree, node, up, steps, total` for `nodes`: `tree, node, parent, score`.

    In table k `up` is the node 2^k steps above, if there is one, `steps` the number of
    nodes from `node` up to just below `up`, and `total` the sum of their scores. A parent
    that is no node of its tree counts as none. Nodes on a cycle or below one still have an
    `up` in the last table.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    above = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    first = nodes.join(known, above, "left").select(
        "tree", "node", F.col("n").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total")
    )
    tables = [_written(first, "ancestors")]
    most = tables[0].count().bit_length()
    while len(tables) <= most and not tables[-1].where("up IS NOT NULL").isEmpty():
        state = tables[-1]
        higher = state.select(*(F.col(c).alias(f"_{c}") for c in state.columns))
        on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node"))
        doubled = state.where("up IS NOT NULL").join(higher, on).select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("total") + F.col("_total")).alias("total"),
        )
        tables.append(_written(doubled.union(state.where("up IS NULL")), "ancestors"))
    return tables


def best_paths(
    rows: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    score: str | None = None,
    best: int | None = None,
) -> DataFrame:
    """`tree, leaf, branch, score, position, node`: the nodes of every chosen path, in order.

    A path leads from a root, position 1, to a node that nothing answers. Its score is the
    sum of the scores of its nodes, NULL counting 0. Of every tree the `best` paths are
    chosen, all if it is None; `branch` numbers them from 1 by falling score, then by leaf
    (0 if all are chosen).

    Rows with a NULL parent, or one that is not in their tree, are roots. A NULL tree is a
    tree like any other; a NULL node is a node that nothing can answer. Rows that repeat a
    node are one node with the least parent and, of those, the least score. Nodes on a cycle
    or below one have no path. An empty table gives an empty table. Other columns of `rows`
    are ignored.
    """
    value = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    nodes = rows.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), value.alias("score")
    )
    one = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("one"))
    nodes = _written(one.select("tree", "node", "one.parent", "one.score"), "nodes")
    tables = ancestors(nodes)
    answered = tables[0].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("up").alias("u"))
    top = tables[-1].where("up IS NULL")
    leaves = top.join(
        answered, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("u")), "left_anti"
    ).select("tree", F.col("node").alias("leaf"), F.col("total").alias("score"), "steps")
    if best is None:
        leaves = leaves.withColumn("branch", F.lit(0))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        leaves = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    stretch = leaves.select(
        "tree", "leaf", "branch", "score", F.col("steps").alias("position"), F.col("leaf").alias("node"), "steps"
    )
    for k in reversed(range(len(tables) - 1)):
        stretch = _written(stretch, "paths")
        reach = 1 << k
        jump = tables[k].where("up IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        far = stretch.where(F.col("steps") > reach).join(
            jump, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("n"))
        )
        below = F.struct("node", "position", F.lit(reach).cast("bigint").alias("steps"))
        above = F.struct(
            F.col("up").alias("node"),
            (F.col("position") - reach).alias("position"),
            (F.col("steps") - reach).alias("steps"),
        )
        cut = far.select("tree", "leaf", "branch", "score", F.explode(F.array(below, above)).alias("part"))
        cut = cut.select("tree", "leaf", "branch", "score", "part.position", "part.node", "part.steps")
        stretch = stretch.where(F.col("steps") <= reach).union(cut)
    return stretch.drop("steps")
