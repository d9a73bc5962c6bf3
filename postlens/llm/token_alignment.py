"""Alignment of two tokenizers over a corpus, and how often ids of one stand for the other's.

A first pass links tokens of both tokenizers that cover the same bytes and writes, task by
task, the distinct id pairs with the number of documents that hold them. A minimal perfect
hash function is built over all distinct pairs, bucket by bucket. Every task's counts are
laid into dense vectors at the pairs' indexes, and these are summed in a tree. A second pass
aligns the documents again and looks the counts up, after comparing the stored pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import importable
from postlens.workspace import new_folder

# Distinct pairs of a bucket, about: one task builds its function and holds its vectors.
BUCKET = 1 << 17

# Rows of pairs that are laid into one vector, and vectors that one task adds up, about.
ROWS = 1 << 20
FAN_IN = 32

# Pairs whose counts a pass over the documents takes along: 16 bytes of each are broadcast.
SLICE = 4_000_000

# Text bytes of the documents that are aligned at a time, except for single longer ones.
STEP = 1 << 20

# Pairs a task holds before it adds equal ones up.
HELD = 2_000_000

_units: dict[tuple, object] = {}


def _written(rows: DataFrame, name: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


class Vocabularies:
    """The files of both tokenizers, read on the driver and sent to the workers."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str) -> None:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))
        self.name = uuid.uuid4().hex

    def units(self, printing: bool = False):
        """This worker's parts; kept from task to task of one pass."""
        from postlens.llm.token_units import Tokenizers, Units

        if (self.name, printing) not in _units:
            _units.clear()
            _units[self.name, printing] = Units(Tokenizers(*self.files.value), printing)
        return _units[self.name, printing]


def _steps(batch, at: int) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch's column, some at a time, with the place of the first; NULL is empty."""
    held, size, first = [], 0, 0
    for i, value in enumerate(batch.column(at)):
        text = value.as_py() or ""
        if held and size + len(text) > STEP:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _alignable(units, parts, text: str) -> bool:
    return bool(text) and bool(units.rows[0, parts].all())


def pairs_by_task(docs: DataFrame, text: str, vocabularies: Vocabularies) -> DataFrame:
    """`part, place, pair, docs`: by task, the documents that hold each pair linked.

    `place` is a hash of the pair, by which it has its bucket.
    """

    def batches(stream: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, units = TaskContext.get().partitionId(), vocabularies.units()
        held, size = [], 0

        def out():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            return pairs, counts

        for batch in stream:
            for _, texts in _steps(batch, 0):
                for value, parts in zip(texts, units.numbers(texts), strict=True):
                    if _alignable(units, parts, value):
                        own = np.unique(units.links_of(np.unique(parts)))
                        held.append((own, np.ones(len(own), np.int64)))
                        size += len(own)
                    if size > HELD:
                        held = [out()]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield _pair_batch(pa, part, *held[0])
                            held, size = [], 0
        if held:
            yield _pair_batch(pa, part, *out())

    return docs.select(text).mapInArrow(batches, "part int, place int, pair bigint, docs bigint")


def _pair_batch(pa, part, pairs, counts):
    import numpy as np

    parts = np.full(len(pairs), part, np.int32)
    columns = [pa.array(c) for c in (parts, places(pairs), pairs.view(np.int64), counts)]
    return pa.RecordBatch.from_arrays(columns, ["part", "place", "pair", "docs"])


def places(pairs):
    """31 bits of hash of every pair."""
    import numpy as np

    from postlens.llm.shingles import mixed

    return (mixed(pairs) >> np.uint64(33)).astype(np.int32)


def _built(table):
    """One bucket's hash function and its pairs in order of index."""
    import numpy as np
    import pyarrow as pa

    from postlens.llm import perfect_hash

    pairs = np.asarray(table.column("pair").to_numpy()).view(np.uint64)
    function = perfect_hash.build(pairs)
    ordered = np.empty_like(pairs)
    ordered[perfect_hash.PerfectHash(function).indexes(pairs)] = pairs
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "size": pa.array([len(pairs)], pa.int64()),
            "function": pa.array([function], pa.binary()),
            "pairs": pa.array([ordered.tobytes()], pa.binary()),
        }
    )


def _vector(table, bucket: int, salt: int, counts):
    import pyarrow as pa

    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int32()),
            "salt": pa.array([salt], pa.int32()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
        }
    )


def _counted(left, right):
    """Some tasks' counts of one bucket as one dense vector."""
    import numpy as np
    import pyarrow as pa

    from postlens.llm import perfect_hash

    if not left.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "salt": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    function = perfect_hash.PerfectHash(right.column("function")[0].as_py())
    stored = np.frombuffer(right.column("pairs")[0].as_py(), np.uint64)
    pairs = np.asarray(left.column("pair").to_numpy()).view(np.uint64)
    at = function.indexes(pairs)
    if (at < 0).any() or (stored[at] != pairs).any():
        raise ValueError("a pair is not the one stored at its index")
    docs = np.asarray(left.column("docs").to_numpy())
    counts = np.bincount(at, docs, len(stored)).astype(np.int64)
    return _vector(left, left.column("bucket")[0].as_py(), left.column("salt")[0].as_py(), counts)


def _added(table):
    """The sum of vectors of one bucket."""
    import numpy as np

    total = None
    for data in table.column("counts"):
        counts = np.frombuffer(data.as_py(), np.int64)
        total = counts.copy() if total is None else total + counts
    return _vector(table, table.column("bucket")[0].as_py(), table.column("salt")[0].as_py(), total)


def _bucket(buckets: int):
    return F.pmod("place", F.lit(buckets)).cast("int")


def pair_index(docs: DataFrame, text: str, vocabularies: Vocabularies) -> tuple[DataFrame, int]:
    """`bucket, size, function, pairs, counts`, one row per bucket, and the number of buckets.

    `pairs` and `counts` are arrays of 8-byte numbers in order of the function's index: A's id
    in the upper half and B's in the lower, and the documents that hold the pair linked.
    """
    spark = docs.sparkSession
    importable(spark)
    found = _written(pairs_by_task(docs, text, vocabularies), "pairs")
    distinct = _written(found.select("pair", "place").distinct(), "distinct-pairs")
    buckets = max(1, -(-distinct.count() // BUCKET))
    schema = "bucket int, size bigint, function binary, pairs binary"
    index = distinct.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_built, schema)
    index = _written(index, "pair-index")
    salts = max(1, -(-found.count() // (buckets * ROWS)))
    salted = found.select(
        _bucket(buckets).alias("bucket"), F.pmod("part", F.lit(salts)).cast("int").alias("salt"), "pair", "docs"
    )
    every = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    schema = "bucket int, salt int, counts binary"
    counts = salted.groupBy("bucket", "salt").cogroup(every.groupBy("bucket", "salt")).applyInArrow(_counted, schema)
    while salts > 1:
        salts = -(-salts // FAN_IN)
        counts = counts.withColumn("salt", F.expr(f"salt div {FAN_IN}").cast("int"))
        counts = counts.groupBy("bucket", "salt").applyInArrow(_added, schema)
    return _written(index.join(counts.drop("salt"), "bucket"), "pair-counts"), buckets


def pair_counts(index: DataFrame) -> DataFrame:
    """`a, b, docs` of every distinct pair of an index."""

    def batches(stream: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in stream:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((pairs >> np.uint64(32)).astype(np.int32)),
                        pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                        pa.array(np.frombuffer(row["counts"], np.int64)),
                    ],
                    ["a", "b", "docs"],
                )

    return index.select("pairs", "counts").mapInArrow(batches, "a int, b int, docs bigint")


class Lookup:
    """Counts of the pairs of some buckets, and whether they are their A id's highest."""

    def __init__(self, rows: list[tuple], buckets: int, best: dict[int, int]) -> None:
        import numpy as np

        from postlens.llm import perfect_hash

        self.buckets, self.of, self.generation = buckets, {}, None
        highest = np.zeros(max(best, default=0) + 1, np.int64)
        highest[list(best)] = list(best.values())
        for bucket, function, pairs, counts in rows:
            stored, docs = np.frombuffer(pairs, np.uint64), np.frombuffer(counts, np.int64)
            top = docs == highest[(stored >> np.uint64(32)).astype(np.int64)]
            self.of[bucket] = perfect_hash.PerfectHash(function), stored, docs, top

    def sums(self, links):
        """The count of every link, and whether it is the highest; 0 for pairs of other buckets."""
        import numpy as np

        counts, best = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
        bucket = places(links) % self.buckets
        order = np.argsort(bucket, kind="stable")
        heads = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b, (function, stored, docs, top) in self.of.items():
            here = order[heads[b] : heads[b + 1]]
            at = function.indexes(links[here])
            here, at = here[at >= 0], at[at >= 0]
            here, at = here[stored[at] == links[here]], at[stored[at] == links[here]]
            counts[here], best[here] = docs[at], top[at]
        return counts, best

    def of_parts(self, units):
        """For every part that `units` knows, its highest links and the sum of its counts."""
        import numpy as np

        if self.generation is not units.generation:
            self.generation, self.known = units.generation, np.zeros((2, 0), np.int64)
        new = np.arange(self.known.shape[1], len(units.number))
        if len(new):
            counts, best = self.sums(units.links_of(new))
            ends = np.cumsum(units.rows[4, new])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (best, counts)]
            self.known = np.concatenate([self.known, np.array(sums)], axis=1)
        return self.known


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_lookups: dict[str, object] = {}


def _looked_up(docs: DataFrame, text: str, keep: list[str], vocabularies: Vocabularies, rows, buckets, best) -> DataFrame:
    """The columns `keep`, the counts and `groups`; counts of pairs in `rows` only."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((rows, buckets, best))
    new = [*COUNTS, "groups"]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("groups", T.StringType())]
    )

    def batches(stream: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        units = vocabularies.units(printing=True)
        if name not in _lookups:
            _lookups.clear()
            _lookups[name] = Lookup(*sent.value)
        lookup = _lookups[name]
        for batch in stream:
            for first, texts in _steps(batch, len(keep)):
                numbers = units.numbers(texts)
                sums = lookup.of_parts(units)
                found, groups = np.zeros((len(COUNTS), len(texts)), np.int64), []
                for i, (value, parts) in enumerate(zip(texts, numbers, strict=True)):
                    if not _alignable(units, parts, value):
                        groups.append("")
                        continue
                    found[:4, i] = units.rows[1:5, parts].sum(axis=1)
                    found[4:, i] = sums[:, parts].sum(axis=1)
                    groups.append(";".join([units.groups[p] for p in parts.tolist()]))
                kept = [c.slice(first, len(texts)) for c in batch.columns[: len(keep)]]
                columns = [*kept, *(pa.array(x) for x in found), pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *new])

    return docs.select(*keep, docs[text].alias("_text_to_align")).mapInArrow(batches, schema)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: `key`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups`.

    A is a byte-level tokenizer in a JSON file, given a space and the text; B a piece model,
    which adds that space. `groups` prints A's and B's ids, `a1,a2|b1;a3|b2,b3`, in groups
    that end where tokens of both end; within a group each is linked with each. A pair's count
    is the number of rows that hold it linked anywhere; `count_sum` adds the counts of all
    links, `n_best` counts those whose count is the highest of their A id, ties included.

    NULL and empty texts, and those whose tokens do not spell a space and the text, have no
    tokens: zeros, and empty groups. Repeated rows are rows of their own, whatever their
    keys; NULL keys pass through. An empty table gives an empty table. Long texts are aligned
    whole. Other columns are ignored.

    The driver reads both vocabularies and, at most, the highest count of every id of A and
    the pairs of `SLICE`; more pairs than that are looked up in several passes.
    """
    spark = docs.sparkSession
    importable(spark)
    vocabularies = Vocabularies(spark, a_path, b_path)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    index, buckets = pair_index(docs, "text", vocabularies)
    highest = pair_counts(index).groupBy("a").agg(F.max("docs").alias("docs"))
    best = {row["a"]: row["docs"] for row in highest.collect()}
    sizes = sorted((row["bucket"], row["size"]) for row in index.select("bucket", "size").collect())
    slices, held = [[]], 0
    for bucket, size in sizes:
        if slices[-1] and held + size > SLICE:
            slices.append([])
            held = 0
        slices[-1].append(bucket)
        held += size

    def passed(rows: DataFrame, keep: list[str], some: list[int]) -> DataFrame:
        of_slice = index.where(F.col("bucket").isin(some)).select("bucket", "function", "pairs", "counts")
        sent = [tuple(bytes(x) if i else x for i, x in enumerate(row)) for row in of_slice.collect()]
        return _looked_up(rows, "text", keep, vocabularies, sent, buckets, best)

    if len(slices) == 1:
        return passed(docs, ["key"], slices[0]).withColumnRenamed("key", key)
    numbered = _written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = passed(numbered, ["row", "key"], slices[0])
    for some in slices[1:]:
        more = passed(numbered, ["row"], some).select(
            "row", F.col("n_best").alias("_best"), F.col("count_sum").alias("_sum")
        )
        found = found.join(more, "row").withColumns(
            {"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")}
        )
        found = found.drop("_best", "_sum")
    return found.drop("row").withColumnRenamed("key", key)
