"""Published batches, running reports and checked tokens, over restarts and stopped attempts."""

import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import label_posts, label_report, prepare_lexicon
from postlens.plans import compact_lake, tokenize_checked, tokenize_lake
from postlens.sources import bounded, read_tokens, rules_table
from postlens.streaming import (
    add_rules,
    batches,
    read_batch_counts,
    read_checked_tokens,
    read_labels,
    read_rejected,
    read_report,
    rules_version,
    run_available,
    start_labels,
    start_report,
    stream_tokens,
)

TIMEOUT = 300
POSTS = [("1", "so good"), ("2", "bad bad"), ("3", "good"), ("4", None), ("5", "x y")]


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f"{row if isinstance(row, str) else json.dumps(row)}\n" for row in rows))


def post(number, text, account=None):
    return {"data": {"id": number, "text": text, "account": account}}


def tokens_of(spark, folder, posts, name):
    write_lines(folder / "lines", f"{name}.json", [post(*p) for p in posts])
    stream = tokenize_lake(
        spark, str(folder / "lines"), str(folder / "tokens"), str(folder / "tokens-ck"), available_now=True, max_files=1
    )
    run_available(stream, TIMEOUT)


def uncommit(checkpoint):
    """Forget the last commit, so that the last batch runs again."""
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def label(spark, folder, lexicon, plan="broadcast"):
    stream = start_labels(
        stream_tokens(spark, str(folder / "tokens"), max_files=1),
        prepare_lexicon(lexicon, plan),
        str(folder / "labels"),
        str(folder / "labels-ck"),
        available_now=True,
    )
    run_available(stream, TIMEOUT)


def ids(rows):
    return sorted(r["id"] for r in rows.select("id").collect())


def test_a_stop_between_the_phases(spark, lexicon, tmp_path, monkeypatch):
    tokens_of(spark, tmp_path, POSTS[:3], "a")
    label(spark, tmp_path, lexicon)
    tokens_of(spark, tmp_path, POSTS[3:], "b")

    def stopped(*_):
        raise RuntimeError("stopped between the phases")

    with monkeypatch.context() as patch:
        patch.setattr(batches, "publish", stopped)
        with pytest.raises(Exception, match="stopped between the phases"):
            label(spark, tmp_path, lexicon)
    assert len(list((tmp_path / "labels").glob("batch-1-*"))) == 1
    before = read_labels(spark, str(tmp_path / "labels"))
    assert ids(before) == ["1", "2", "3"]
    label(spark, tmp_path, lexicon)
    assert len(list((tmp_path / "labels").glob("batch-1-*"))) == 2
    assert ids(read_labels(spark, str(tmp_path / "labels"))) == ["1", "2", "3", "4", "5"]
    # A table read before goes on showing what was published then.
    assert ids(before) == ["1", "2", "3"]


def test_a_repeated_batch_leaves_the_published_one(spark, lexicon, tmp_path):
    tokens_of(spark, tmp_path, POSTS[:3], "a")
    tokens_of(spark, tmp_path, POSTS[3:], "b")
    label(spark, tmp_path, lexicon)
    folders = sorted(p.name for p in (tmp_path / "labels").glob("batch-*"))
    uncommit(tmp_path / "labels-ck")
    before = read_labels(spark, str(tmp_path / "labels"))
    label(spark, tmp_path, lexicon)
    assert sorted(p.name for p in (tmp_path / "labels").glob("batch-*")) == folders
    assert ids(before) == ids(read_labels(spark, str(tmp_path / "labels"))) == ["1", "2", "3", "4", "5"]


def test_batches_of_nothing(spark, tmp_path):
    from postlens.schemas import LABELS

    path = str(tmp_path / "none")
    assert batches.published(spark, path) is None
    assert batches.read_batches(spark, path, LABELS).count() == 0
    empty = spark.createDataFrame([], LABELS)
    batches.write_batch(empty, path, 0)
    batches.write_batch(spark.createDataFrame([("1", 2, "x")], LABELS), path, 12)
    assert set(batches.published(spark, path)) == {0, 12}
    assert [tuple(r) for r in batches.read_batches(spark, path, LABELS).collect()] == [("1", 2, "x", 12)]
    assert batches.read_batches(spark, path, LABELS, last=True).count() == 1


def follow(spark, folder, lexicon, plan="row"):
    stream = start_report(
        stream_tokens(spark, str(folder / "tokens"), max_files=1),
        prepare_lexicon(lexicon, plan),
        str(folder / "report"),
        str(folder / "report-ck"),
        available_now=True,
    )
    run_available(stream, TIMEOUT)


def test_running_report(spark, lexicon, tmp_path):
    path = str(tmp_path / "report")
    assert read_report(spark, path).count() == 0
    for number, cut in enumerate((slice(0, 2), slice(2, 4), slice(4, 5))):
        tokens_of(spark, tmp_path, POSTS[cut], f"l{number}")
        follow(spark, tmp_path, lexicon)
        so_far = spark.createDataFrame(POSTS[: cut.stop], "id string, text string")
        expected = label_report(label_posts(so_far, lexicon, "nw"), "share").collect()
        assert read_report(spark, path).collect() == expected
    # The last batch again, as after a lost commit: no post counts twice.
    uncommit(tmp_path / "report-ck")
    follow(spark, tmp_path, lexicon)
    assert read_report(spark, path).collect() == expected
    with pytest.raises(ValueError, match="row plan"):
        follow(spark, tmp_path, lexicon, "broadcast")


def check(spark, folder, rules=None):
    stream = tokenize_checked(
        spark, str(folder / "lines"), str(folder / "out"), str(folder / "ck"), rules, available_now=True, max_files=1
    )
    run_available(stream, TIMEOUT)


def test_rules_change_between_batches(spark, tmp_path):
    rules, out = str(tmp_path / "rules"), str(tmp_path / "out")
    with pytest.raises(Exception, match="holds no rules"):
        write_lines(tmp_path / "lines", "a.json", [post("1", "x", "a"), post("2", "y", "b"), post("3", "z", None)])
        check(spark, tmp_path, rules)
    assert add_rules(rules_table(spark, {"from:a": "A", "to:b": "no rule"}), rules) == 1
    check(spark, tmp_path, rules)
    assert add_rules(rules_table(spark, {"from:b": "B"}), rules) == 2
    write_lines(tmp_path / "lines", "b.json", [post("4", "x", "a"), post("5", "y", "b")])
    check(spark, tmp_path, rules)
    expected = [("1", "a", "A", 0), ("5", "b", "B", 1)]
    found = lambda: sorted(tuple(r) for r in read_checked_tokens(spark, out).select("id", "account", "tag", "batch_id").collect())
    assert found() == expected
    assert [r["value"] for r in rules_version(spark, rules, 2).collect()] == ["from:b"]


def test_a_repeated_batch_keeps_its_rules(spark, tmp_path, monkeypatch):
    rules, out = str(tmp_path / "rules"), str(tmp_path / "out")
    add_rules(rules_table(spark, {"from:a": "A"}), rules)
    write_lines(tmp_path / "lines", "a.json", [post("1", "x", "a"), post("2", "y", "b")])

    def stopped(*_):
        raise RuntimeError("stopped between the phases")

    with monkeypatch.context() as patch:
        patch.setattr(batches, "publish", stopped)
        with pytest.raises(Exception, match="stopped between the phases"):
            check(spark, tmp_path, rules)
    assert read_checked_tokens(spark, out).count() == 0
    # The publishing of rules goes through the same two phases, so it must work again first.
    add_rules(rules_table(spark, {"from:b": "B"}), rules)
    check(spark, tmp_path, rules)
    assert [(r["id"], r["tag"]) for r in read_checked_tokens(spark, out).collect()] == [("1", "A")]
    assert [r["rules_version"] for r in read_batch_counts(spark, out).collect()] == [1]


BAD = ["", "not json", '{"e":1}', '{"data":5}', '{"data":{"id":"9","text":"cut']


def test_rejected_lines_are_kept_and_counted(spark, tmp_path):
    out = str(tmp_path / "out")
    write_lines(tmp_path / "lines", "a.json", [post("1", "so good"), *BAD[:2]])
    check(spark, tmp_path)
    write_lines(tmp_path / "lines", "b.json", [*BAD[2:], post("2", None), post("3", "a b", "x")])
    check(spark, tmp_path)
    counts = read_batch_counts(spark, out).orderBy("batch_id").collect()
    assert [(r["n_lines"], r["n_rejected"], r["rules_version"]) for r in counts] == [(3, 2, None), (5, 3, None)]
    assert sorted(r["value"] for r in read_rejected(spark, out).collect()) == sorted(BAD)
    tokens = read_checked_tokens(spark, out).orderBy("id").collect()
    assert [(r["id"], r["text"], r["account"], r["tag"]) for r in tokens] == [
        ("1", ["so", "good"], None, None),
        ("2", None, None, None),
        ("3", ["a", "b"], "x", None),
    ]


def test_compaction_gives_every_row_once(spark, tmp_path):
    """Small files become few, over two runs; a stream on the new folder sees no row twice."""
    new = str(tmp_path / "compact")
    for number in range(2):
        for part in range(3):
            tokens_of(spark, tmp_path, [(f"{number}-{part}-{i}", "so good") for i in range(4)], f"{number}-{part}")
        run_available(compact_lake(spark, str(tmp_path / "tokens"), new, str(tmp_path / "compact-ck"), files=1), TIMEOUT)
        follow_on = (
            stream_tokens(spark, new).writeStream.format("parquet").option("path", str(tmp_path / "seen"))
            .option("checkpointLocation", str(tmp_path / "seen-ck")).trigger(availableNow=True).start()
        )
        run_available(follow_on, TIMEOUT)
    before, after = read_tokens(spark, str(tmp_path / "tokens")), read_tokens(spark, new)
    assert len(before.inputFiles()) == 6 and len(after.inputFiles()) == 2
    assert before.count() == after.count() == 24 and before.exceptAll(after).isEmpty()
    assert ids(spark.read.parquet(str(tmp_path / "seen"))) == ids(before)


def test_compaction_of_much_is_not_one_task(spark, tmp_path):
    """One file is asked for, but no task takes in more than a file may; settings stay as they were."""
    for part in range(12):
        posts = [(f"{part}-{i}", f"w{part} {' '.join(str(hash((part, i, j))) for j in range(40))}") for i in range(40)]
        tokens_of(spark, tmp_path, posts, str(part))
    before = read_tokens(spark, str(tmp_path / "tokens"))
    sizes = [(tmp_path / "tokens" / name.rsplit("/", 1)[1]).stat().st_size for name in before.inputFiles()]
    settings = dict(spark.conf.getAll)
    most = int(2.5 * max(sizes))
    stream = compact_lake(
        spark, str(tmp_path / "tokens"), str(tmp_path / "new"), str(tmp_path / "new-ck"), files=1, file_bytes=most
    )
    run_available(stream, TIMEOUT)
    assert dict(spark.conf.getAll) == settings
    after = read_tokens(spark, str(tmp_path / "new"))
    assert len(after.inputFiles()) == 6 < len(before.inputFiles()) == 12
    assert before.count() == after.count() == 480 and before.exceptAll(after).isEmpty()


def test_batches_bounded_by_bytes(spark, tmp_path):
    write_lines(tmp_path / "lines", "huge.json", [post("0", "word " * 40_000)])
    for i in range(1, 9):
        write_lines(tmp_path / "lines", f"small{i}.json", [post(str(i), "word " * 1_000)])
    stream = tokenize_lake(
        spark,
        str(tmp_path / "lines"),
        str(tmp_path / "tokens"),
        str(tmp_path / "ck"),
        available_now=True,
        max_bytes=12_000,
    )
    sizes = []
    run_available(stream, TIMEOUT)
    sizes = [p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]]
    assert sum(sizes) == 9 and max(sizes) <= 2 and len(sizes) >= 5
    assert read_tokens(spark, str(tmp_path / "tokens")).agg(F.count_distinct("id")).first()[0] == 9
    text = bounded(spark.readStream, max_files=3, max_bytes=50).text(str(tmp_path / "lines"))
    assert text.isStreaming
