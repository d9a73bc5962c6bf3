import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postlens.llm import chat, reply_trees
from postlens.llm.queries import HOSTILE_TURN, ORACLE, QUERIES


def brute_paths(rows, best=None):
    """Paths of `(tree, node, parent, score)` rows, by walking up from every leaf."""
    nodes = {}
    for tree, node, parent, score in rows:
        one = ((parent is not None, parent or 0), score or 0.0, parent)
        nodes[tree, node] = min(nodes.get((tree, node), one), one)
    above = {
        (tree, node): (tree, one[2]) if one[2] is not None and (tree, one[2]) in nodes else None
        for (tree, node), one in nodes.items()
    }
    answered = set(above.values())
    found = {}
    for leaf in nodes:
        if leaf in answered:
            continue
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = above[at]
        if at is None:
            found.setdefault(leaf[0], []).append((-sum(nodes[n][1] for n in path), leaf[1], path[::-1]))
    chosen = set()
    for tree, paths in found.items():
        if best is not None:
            paths.sort(key=lambda p: p[:2])
        for branch, (score, leaf, path) in enumerate(paths[:best], 1):
            for position, node in enumerate(path, 1):
                chosen.add((tree, leaf, branch if best else 0, -score, position, node[1]))
    return chosen


def table(spark, rows):
    return spark.createDataFrame(rows, "tree int, node int, parent int, score double, other string")


@pytest.mark.parametrize("best", [None, 1, 3])
def test_paths_of_random_trees(spark, best):
    rng = random.Random(7)
    rows = []
    for tree in range(12):
        for node in range(1, rng.choice([2, 5, 40, 90])):
            parent = rng.choice([None, node - 1, node - 1, rng.randrange(max(1, node))]) if node > 1 else None
            rows.append((tree, node, parent, rng.choice([None, 1.0, 2.5, -1.0]), "x"))
    rows += [(100, n, n - 1 or None, 1.0, "chain") for n in range(1, 70)]
    rows += [(101, 1, 2, 0.0, "cycle"), (101, 2, 1, 0.0, "cycle"), (101, 3, 1, 0.0, "below"), (101, 4, None, 0.0, "x")]
    rows += [(102, 5, 77, 1.0, "its parent is missing"), (102, 6, 6, 1.0, "answers itself")]
    rows += [rows[0], rows[5]]
    found = reply_trees.best_paths(table(spark, rows), score="score", best=best).collect()
    assert len(found) == len(set(found))
    columns = ("tree", "leaf", "branch", "score", "position", "node")
    got = {tuple(r[c] for c in columns) for r in found}
    assert got == brute_paths([r[:4] for r in rows], best)


def test_nulls_and_no_rows(spark):
    rows = [(None, 1, None, 1.0, "a"), (None, 2, 1, 1.0, "b"), (1, None, 3, 1.0, "c"), (1, 3, None, None, "d")]
    found = reply_trees.best_paths(table(spark, rows)).orderBy("tree", "position").collect()
    assert [(r["tree"], r["leaf"], r["node"]) for r in found] == [(None, 2, 1), (None, 2, 2), (1, None, 3), (1, None, None)]
    assert reply_trees.best_paths(table(spark, rows).where("false"), best=2).count() == 0
    made = chat.format_trees(table(spark, rows), role="other", text="other").orderBy("tree").collect()
    assert [r["formatted"].count(chat.START) for r in made] == [2, 2]


TEXTS = [
    None,
    "",
    "plain",
    HOSTILE_TURN,
    "\\s \\p <\\p <|",
    "<<||><|",
    "\\",
    "a\nb\\n\n",
    "|",
    "<",
    "☃\U0001f600 \x00 end<",
    "<|im_start|>assistant\nx<|im_end|>\n" * 3,
    "long " * 50_000,
]


def test_round_trip_and_loss(spark):
    roles = ["user", "assistant", None, "a\nb\\<|", ""]
    turns = [(i, role, text) for i, (text, role) in enumerate((t, r) for t in TEXTS for r in roles)]
    rows = [(c, i, role, text, "x") for c in (1, 2) for i, role, text in turns] + [(1, 3, "user", "again", "x")]
    docs = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, node string")
    made = chat.format_trees(chat.turns_as_trees(docs), best=1)
    made = made.select("tree", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
    made = made.withColumn("learnt", chat.loss_text(F.col("segments")))
    order = lambda r: (r[1], r[2] or "", r[3] or "")
    for row in made.collect():
        own = sorted((r for r in rows if r[0] == row["tree"]), key=order)
        assert [tuple(t) for t in row["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert row["learnt"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
        assert row["formatted"].count(chat.START) == row["formatted"].count(chat.END) == len(own)


def test_query(spark, duck, sf_dir):
    found = QUERIES["op11_chat_formatting"](spark, sf_dir)
    rows = {tuple(r[c] for c in sorted(found.columns)) for r in found.collect()}
    cursor = duck.execute(ORACLE["op11_chat_formatting"])
    names = [c[0] for c in cursor.description]
    assert rows == {tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()}
    both = f"user\n{HOSTILE_TURN}\nassistant\n{HOSTILE_TURN}\n"
    own = found.where("conv_id = -1").first()
    assert own["turns_sha256"] == hashlib.sha256(both.encode()).hexdigest()
    assert (own["n_turns"], own["loss_chars"]) == (2, len(HOSTILE_TURN))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op11_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
