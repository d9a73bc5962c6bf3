"""Chat formatting: every chosen path of a reply tree becomes one marked-up conversation.

A turn is written as `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end.
Inside roles and texts a backslash becomes `\\s` and `<|` becomes `<\\p`, in roles a line end
becomes `\\n`, so no control string can come from a text and all are read back exactly.
The output is a list of segments, of which those under the loss are marked; put together
they are the formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.reply_trees import best_paths

# The template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """A text without control strings; NULL counts as empty."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s"))
    return F.replace(plain, F.lit("<|"), F.lit("<\\p"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """What `escaped` or `escaped_role` was given. Every backslash begins one of three pairs."""
    lines = F.replace(text, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def segments(turns: Column) -> Column:
    """The segments `text, loss` of an array of turns `role, text`, in order.

    Under the loss are the texts of the assistant, without markers.
    """
    parts = F.transform(
        turns,
        lambda t: F.array(
            F.struct(
                F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("text"),
                F.lit(False).alias("loss"),
            ),
            F.struct(
                escaped(t["text"]).alias("text"),
                F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("loss"),
            ),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        ),
    )
    return F.flatten(parts)


def formatted(found: Column) -> Column:
    """The conversation that segments make up."""
    return F.array_join(F.transform(found, lambda s: s["text"]), "")


def read_turns(conversation: Column) -> Column:
    """The turns `role, text` of a formatted conversation."""
    pieces = F.split(conversation, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        begin, around = F.length(role) + 2, F.length(role) + 1 + len(END) + 1
        text = F.substring(piece, begin, F.length(piece) - around)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(found: Column) -> Column:
    """All text under the loss, unescaped, with nothing between."""
    under = F.filter(found, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"])), "")


def format_trees(
    rows: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    best: int | None = None,
) -> DataFrame:
    """One row per chosen path: `tree, leaf, branch, score, segments, formatted`.

    Paths are those of `best_paths`, with its rules for NULLs, ties, missing parents and
    cycles. NULL roles and texts are empty; of rows that repeat a node the least role and
    text count. A conversation is one row, so its texts must fit a row.
    """
    paths = best_paths(rows, tree, node, parent, score, best)
    turns = rows.select(
        F.col(tree).alias("t"),
        F.col(node).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    on = F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("n"))
    placed = paths.join(turns, on).groupBy("tree", "leaf", "branch", "score")
    found = placed.agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    first = F.filter(
        "turns", lambda t, i: F.coalesce(F.get("turns", i - 1)["position"] != t["position"], F.lit(True))
    )
    found = found.withColumn("segments", segments(first)).drop("turns")
    return found.withColumn("formatted", formatted(F.col("segments")))


def turns_as_trees(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows `tree, node, parent, role, text` of conversations in which every turn answers the last.

    Turns are ordered by number, NULL first, then by role and text; repeated rows are turns
    of their own.
    """
    rows = turns.select(
        F.col(conversation).alias("tree"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("_turn"), "role", "text")
    place = F.row_number().over(order)
    return rows.select("tree", place.alias("node"), "role", "text").select(
        "tree", "node", F.expr("nullif(node - 1, 0)").alias("parent"), "role", "text"
    )
