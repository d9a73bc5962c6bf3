"""The trie of conversation prefixes, and what subtrees of it save, by an Euler tour.

A node is a distinct sequence of first turns. The tour enters and leaves every node once;
its arcs are put in order by list ranking, and sums over a subtree are then differences of
prefix sums at the arcs of its top.

A node's representative is its least conversation. Nodes of one representative form a path,
and a path's own child comes first among siblings, so all arcs of a path between two
branches follow each other: only such stretches are ranked, not single arcs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import importable, words
from postlens.llm.list_ranking import list_ranks
from postlens.workspace import new_folder

# Arcs whose prefix sums one task makes.
BLOCK = 65_536

ROOT = hashlib.sha256(b"root").digest()[:16]


def _written(rows: DataFrame, name: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _prefixes(stream: Iterator) -> Iterator:
    """From rows by conversation and turn: the digest of the prefix that ends at each row."""
    import pyarrow as pa

    names = ["node", "parent", "depth", "conv", "n_words", "ends"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def out(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    last: list | None = None
    for batch in stream:
        rows = []
        for conv, turn, n_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turn is None:
                own = [ROOT, None, 0, conv, 0, True]
            else:
                last[5] = False
                own = [hashlib.sha256(last[0] + turn).digest()[:16], last[0], last[2] + 1, conv, n_words, True]
            if last is not None:
                rows.append(last)
            last = own
        yield out(rows)
    if last is not None:
        yield out([last])


def _ends(stream: Iterator) -> Iterator:
    """From rows by node and conversation: the digest of the conversations of each node."""
    import pyarrow as pa

    held, digest, first = None, None, True
    for batch in stream:
        found = []
        for node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != held:
                if held is not None:
                    found.append((held, digest.hexdigest()))
                held, digest, first = node, hashlib.sha256(), True
            digest.update(str(conv).encode() if first else b",%d" % conv)
            first = False
        yield _ends_batch(found)
    yield _ends_batch([(held, digest.hexdigest())] if held is not None else [])


def _ends_batch(found: list[tuple]):
    import pyarrow as pa

    nodes, digests = list(zip(*found, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])


def prefix_rows(turns: DataFrame, conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """`node, parent, depth, conv, n_words, ends` for every prefix of every conversation."""
    importable(turns.sparkSession)
    role_text = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    spelled = F.concat(F.octet_length(role_text[0]).cast("string"), F.lit(":"), *role_text)
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv"),
        F.lit(1).alias("kind"),
        F.col(turn).alias("place"),
        F.unhex(F.sha2(spelled.cast("binary"), 256)).alias("turn"),
        F.size(words(role_text[1])).cast("bigint").alias("n_words"),
    )
    ids = [t.select(F.col(conv).cast("bigint").alias("conv")) for t in (turns, conversations)]
    empty = ids[0].union(ids[1]).distinct()
    empty = empty.selectExpr("conv", "0 AS kind", "NULL AS place", "NULL AS turn", "0L AS n_words")
    rows = rows.union(empty.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("place"), "turn")
    schema = "node binary, parent binary, depth bigint, conv bigint, n_words bigint, ends boolean"
    return rows.select("conv", "turn", "n_words").mapInArrow(_prefixes, schema)


def _segment(node: Column, leaving: int) -> Column:
    return F.concat(node, F.lit(bytes([leaving])))


def _tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the stretches and places of their arcs, and the stretches as a linked list.

    `nodes`: `node, parent, depth, conv, own`, the last true for a child of its parent's path.
    Siblings besides that child come in order of a hash bucket, then of their digests, so
    that even a node of very many children is linked up by many tasks.
    """
    others = nodes.where("NOT own")
    buckets = math.isqrt(others.count()) + 1
    others = others.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    within = Window.partitionBy("parent", "bucket").orderBy("node")
    least = others.groupBy("parent", "bucket").agg(F.min("node").alias("least"))
    across = Window.partitionBy("parent").orderBy("bucket")
    least = _written(least.withColumn("later", F.lead("least").over(across)), "siblings")
    following = F.coalesce("following", "later")
    up = F.when(F.col("parent").isNotNull(), _segment(F.col("parent"), 1))
    after = F.when(following.isNotNull(), _segment(following, 0)).otherwise(up)
    # The top of the trie is a child of none; nothing follows it.
    siblings = (
        others.withColumn("following", F.lead("node").over(within))
        .join(least.drop("least"), ["parent", "bucket"])
        .select("node", after.alias("after"))
    )
    branches = least.groupBy("parent").agg(F.min_by("least", "bucket").alias("branch"))
    marked = nodes.join(siblings, "node", "left").join(
        branches.withColumnRenamed("parent", "_parent"), F.col("node") == F.col("_parent"), "left"
    )
    path = Window.partitionBy("conv")
    down = path.orderBy("depth")
    up_to = path.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    to_here = down.rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("branch").isNotNull(), F.struct("depth", "node", "branch"))
    placed = marked.select(
        "node",
        "depth",
        "branch",
        F.min("depth").over(path).alias("top"),
        F.max("depth").over(path).alias("bottom"),
        F.first("node").over(to_here).alias("first"),
        F.first("after").over(to_here).alias("after"),
        F.last(head, ignorenulls=True).over(up_to).alias("head"),
        F.last(head, ignorenulls=True).over(to_here).alias("last_head"),
        F.last(head, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
    )
    length = F.col("bottom") - F.col("top") + 1
    back = F.when(F.col("head").isNull(), length + F.col("bottom") - F.col("depth"))
    placed = placed.withColumns(
        {
            "enters": _segment(F.col("first"), 0),
            "enter_at": F.col("depth") - F.col("top"),
            "leaves": F.coalesce(_segment(F.col("head.node"), 1), _segment(F.col("first"), 0)),
            "leave_at": F.coalesce(back, F.col("head.depth") - F.col("depth")),
        }
    )
    placed = _written(placed, "arcs")

    def link(segment: Column, head: str, none: Column, some: Column) -> list[Column]:
        ended = F.col(head).isNull()
        return [
            segment.alias("id"),
            F.when(ended, F.col("after")).otherwise(_segment(F.col(f"{head}.branch"), 0)).alias("next"),
            F.when(ended, none).otherwise(some).alias("weight"),
        ]

    entering = placed.where("depth = bottom").select(
        *link(F.col("enters"), "last_head", 2 * length, length + F.col("bottom") - F.col("last_head.depth"))
    )
    depth = F.col("depth")
    leaving = placed.where("branch IS NOT NULL").select(
        *link(_segment(F.col("node"), 1), "above", depth - F.col("top") + 1, depth - F.col("above.depth"))
    )
    return placed.select("node", "enters", "enter_at", "leaves", "leave_at"), entering.union(leaving)


def prefix_trie(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per node: `node`, `conv_id`, `depth`, `parent_conv_id` and the numbers below.

    `n_convs` conversations start with the node's turns, `conv_id` is the least of them;
    `n_children` children, `n_leaves` nodes without any in its subtree, itself included;
    `saved_tokens` sums, over the subtree, the words of each node's last text times the
    conversations beyond the first that share it. `ends_sha256` is of the ids, joined by
    commas, of conversations that end at the node.

    `conversations` names further conversations by `conv`, also such without turns. Turns are ordered by number, NULL first; rows of one number in
    a fixed order of their contents. NULL roles and texts are empty. Rows with a NULL id are
    one conversation that is never the least and whose id is not listed. Without any
    conversation there are no rows, not even a root. Ids are whole numbers.
    """
    rows = _written(
        prefix_rows(turns, turns if conversations is None else conversations, conv, turn, role, text), "prefixes"
    )
    listed = rows.where("ends AND conv IS NOT NULL").select("node", "conv")
    ends = listed.repartition("node").sortWithinPartitions("node", "conv")
    ends = ends.mapInArrow(_ends, "node binary, ends_sha256 string")
    nodes = rows.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("n_words").alias("n_words"),
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
    )
    nodes = _written(nodes, "trie")
    tops = nodes.select(F.col("node").alias("_node"), F.col("conv").alias("parent_conv"))
    own = F.col("parent").isNotNull() & F.col("conv").eqNullSafe(F.col("parent_conv"))
    nodes = nodes.join(tops, F.col("parent") == F.col("_node"), "left").drop("_node")
    nodes = _written(nodes.withColumn("own", own), "trie")
    families = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(families.withColumnRenamed("parent", "_node"), F.col("node") == F.col("_node"), "left")
    nodes = _written(nodes.drop("_node").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")

    arcs, stretches = _tour(nodes.select("node", "parent", "depth", "conv", "own"))
    ranks = list_ranks(stretches)
    for way in ("enter", "leave"):
        rank = ranks.select(F.col("id").alias(f"{way}s"), F.col("rank").alias("_rank"))
        arcs = arcs.join(rank, f"{way}s").withColumn(f"{way}_at", F.col(f"{way}_at") + F.col("_rank"))
        arcs = arcs.drop("_rank", f"{way}s")
    weights = nodes.select(
        "node",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
    )
    zero = F.lit(0).cast("bigint")
    entering = F.struct(F.col("enter_at").alias("at"), F.lit(-1).alias("sign"), "leaf", "saved")
    leaving = F.struct(F.col("leave_at").alias("at"), F.lit(1).alias("sign"), zero.alias("leaf"), zero.alias("saved"))
    arcs = arcs.join(weights, "node").select("node", F.explode(F.array(entering, leaving)).alias("arc"))
    arcs = _written(arcs.select("node", "arc.*", F.expr(f"arc.at div {BLOCK}").alias("block")), "arcs")
    blocks = arcs.groupBy("block").agg(F.sum("leaf").alias("leaf_all"), F.sum("saved").alias("saved_all"))
    # One row for each 65,536 arcs.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(f"{c}_all").over(before), zero).alias(f"{c}_before") for c in ("leaf", "saved"))
    )
    here = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # Up to an arc of entering, without its own weight; up to an arc of leaving, which has none.
    sums = arcs.withColumns({f"{c}_here": F.sum(c).over(here) for c in ("leaf", "saved")}).join(blocks, "block")
    at_arc = {c: F.col(f"{c}_before") + F.col(f"{c}_here") - F.col(c) for c in ("leaf", "saved")}
    sums = sums.groupBy("node").agg(
        F.sum(F.col("sign") * at_arc["leaf"]).alias("n_leaves"), F.sum(F.col("sign") * at_arc["saved"]).alias("saved_tokens")
    )
    return (
        nodes.join(sums, "node")
        .join(ends, "node", "left")
        .select(
            "node",
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        )
    )


def with_borrowed_starts(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """`conv_id, turn, role, text` of conversations that begin with turns of another one.

    Conversation c takes its first h turns from c - c % `every` (all if there are fewer,
    none if there is no such conversation) and goes on with its own turns after its first h;
    h is the CRC-32 of c's decimal form modulo `most`. `turn` numbers the rows anew, with
    gaps. A NULL id keeps all its turns.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = rows.withColumn("turn", F.row_number().over(order))
    borrowed = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)), F.lit(0))
    own = placed.where(F.col("turn") > borrowed)
    starts = placed.where((F.col("turn") < most) & (F.col("conv_id") % every == 0))
    starts = starts.withColumnRenamed("conv_id", "_from")
    takers = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    takers = takers.select("conv_id", borrowed.alias("_h"), (F.col("conv_id") - F.col("conv_id") % every).alias("_from"))
    taken = takers.join(starts, "_from").where("turn <= _h")
    columns = ["conv_id", "turn", "role", "text"]
    return own.select(*columns).union(taken.select(*columns))
