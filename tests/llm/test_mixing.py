from collections import defaultdict

from postlens.llm import mixing
from postlens.llm.queries import ORACLE, QUERIES

WEIGHTS = (5.0, 2.0, 1.0)


def expected_targets(sizes):
    """Sizes by source, in order: shares by weight; what is over a cap goes to the others."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        target = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if target[s] > 2 * sizes[s]]
        if not over:
            return target | full
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def check(rows, key="doc_id"):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    targets = expected_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s in sizes:
        assert abs(targets[s] - taken[s]) <= largest[s] / 2 + 1
    return sizes, taken, targets


def test_documents(spark, sf_dir, documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    check(rows)
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_every_source_comes_near_its_target(spark, sf_dir):
    """Sources of ten documents as near as one more could bring them, larger ones within 2%."""
    for size in ("sf0.001", "sf0.01"):
        rows = mixing.mix(spark.read.parquet(f"{sf_dir}/../{size}/documents.parquet")).collect()
        _, taken, targets = check(rows)
        least = defaultdict(lambda: 2)
        for r in rows:
            least[r["source"]] = min(least[r["source"]], r["copies"])
        for r in rows:
            away = abs(targets[r["source"]] - taken[r["source"]])
            assert size == "sf0.001" or away <= 0.02 * targets[r["source"]]
            if r["copies"] == least[r["source"]] < 2:
                assert abs(targets[r["source"]] - taken[r["source"]] - r["size"]) >= away - 1


def test_rows_of_one_key_are_taken_apart(spark):
    rows = [(None, f"w{i} " * 10, "s") for i in range(300)] + [(7, f"x{i} " * 10, "t") for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    _, taken, targets = check(found)
    assert all(abs(taken[s] - targets[s]) <= 5 for s in "st")


def test_odd_rows(odd, nothing):
    rows = mixing.mix(odd.withColumnRenamed("score", "target")).collect()
    assert len(rows) == odd.count()
    check([r for r in rows])
    assert {r["size"] for r in rows if r["doc_id"] in (6, 7, 8)} == {0}
    assert mixing.mix(nothing).count() == 0


def test_unequal_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 2}" if i % 10 else "s2") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(mixing.mix(docs).collect())


def test_rows_come_as_often_as_taken(spark, documents):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(documents).collect()}
    mixed = mixing.mixed_rows(documents)
    assert mixed.columns == documents.columns
    found = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in taken.items() if n}


def test_query_is_sql(spark, duck, sf_dir):
    found = QUERIES["op6_mix_sources"](spark, sf_dir)
    expected = duck.execute(ORACLE["op6_mix_sources"])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(expected.fetchall())
