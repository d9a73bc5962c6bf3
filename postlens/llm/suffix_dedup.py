"""Removal of byte strings that also start in a document of smaller key.

Documents are dealt into runs by a hash of their key and text. Each run sorts its suffixes,
front-codes them and sends each hash range of them to one merge, in which a loser tree
that knows common prefixes puts the runs together; equal suffixes and those that share a
window are then neighbours. What is covered goes back to the runs as spans.

Only suffixes at anchors (see `suffixes`) that texts of several keys have are sorted: all
others cannot share a window, by the way anchors are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import free_prefix, importable
from postlens.llm.jaccard import text_key
from postlens.workspace import new_folder

# Text bytes of a run, on average: what a task holds of the documents at a time.
RUN_BYTES = 8 << 20


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    run_bytes: int = RUN_BYTES,
    whole: bool = False,
) -> DataFrame:
    """One row per row of `docs`: `key`, `n_bytes`, `n_removed`, `n_spans`, `kept`.

    The columns `keep` of `docs` follow, if they are named; their names must be others. If
    `whole`, a character of which a byte goes is removed as a whole.

    Texts are UTF-8 bytes; NULL is empty. A byte is removed if a 50-byte string that covers
    it also starts in a row of smaller key, as the input has them. `n_spans` counts maximal
    removed runs and `kept` holds the other bytes in order, which may cut characters. Rows
    of equal keys do not count against each other; NULL keys come after all others. Texts
    of fewer than 50 bytes stay whole, longer ones are judged over their whole length. Keys
    are whole numbers. Columns not named in `keep` are ignored. An empty table gives an
    empty table.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    importable(spark)
    narrow = docs.select(
        F.col(key).cast("bigint").alias("id"),
        text_key(F.col(text)).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).alias("size"),
    )
    folder = new_folder(spark, "texts")
    narrow.write.parquet(folder)
    narrow = spark.read.parquet(folder)
    total = narrow.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    runs = max(1, -(-total // run_bytes))
    run = run_of(F.col("id"), F.col("key"), runs)
    texts = docs.select(
        F.col(key).cast("bigint").alias("id"),
        text_key(F.col(text)).alias("key"),
        F.col(text).alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep or ())).alias("rest"),
    ).withColumn("run", run)
    texts = texts.select("run", "id", "key", "text", "rest")
    copies = _copies(narrow, run)
    by_run = texts.groupBy("run")

    def anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        return _anchors(left, right, runs)

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        return _sorted(left, right, runs)

    aside = "run int, kind int, id bigint, part int, data binary"
    found = by_run.cogroup(copies.groupBy("run")).applyInArrow(anchors, aside)
    shared = found.groupBy("part").applyInArrow(_shared, aside)
    blocks = by_run.cogroup(copies.union(shared).groupBy("run")).applyInArrow(sort, aside)
    spans = blocks.groupBy("part").applyInArrow(_merged, aside)
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left, right, whole)

    done = by_run.cogroup(copies.union(spans).groupBy("run")).applyInArrow(
        cut, T.StructType([*T.StructType.fromDDL(CUT).fields, texts.schema["rest"]])
    )
    counts = [F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept"]
    return done.select(*counts, *(F.col("rest")[c].alias(c) for c in keep or ()))


CUT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with covered bytes removed from `text`; a column `n_chars` is set anew.

    A character of which a part was removed goes as a whole; all others stay as they are.
    Texts of which nothing is left are empty; no row is dropped. All columns are carried on,
    whatever their names.
    """
    p = free_prefix(docs)
    others = [c for c in docs.columns if c not in (key, text)]
    hidden = {c: f"{p}{i}" for i, c in enumerate(others)}
    plain = docs.select(
        F.col(key).alias(f"{p}id"), F.col(text).alias(f"{p}text"), *(F.col(c).alias(h) for c, h in hidden.items())
    )
    done = remove_repeats(plain, f"{p}id", f"{p}text", list(hidden.values()), whole=True)
    columns = {key: F.col(f"{p}id").cast(docs.schema[key].dataType), text: F.col("kept").cast("string")}
    columns |= {c: F.col(h) for c, h in hidden.items()}
    if "n_chars" in hidden:
        columns["n_chars"] = F.length(columns[text]).cast(docs.schema["n_chars"].dataType)
    return done.select(*(columns[c].alias(c) for c in docs.columns))


def run_of(key: Column, digest: Column, runs: int) -> Column:
    """The run of a row, by key and text: rows of one key, or without one, are spread over all."""
    return F.pmod(F.xxhash64(key, digest), F.lit(runs)).cast("int")


def _copies(narrow: DataFrame, run: Column) -> DataFrame:
    """A row for each row whose text one of smaller key has; the least keys alone are sorted."""
    least = narrow.groupBy("key").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # Written, so that Spark can split the hot partition of a text with very many copies.
    folder = new_folder(narrow.sparkSession, "least-keys")
    least.where("_n > 1").drop("_n").write.parquet(folder)
    least = narrow.sparkSession.read.parquet(folder)
    later = narrow.join(least, "key").where(
        "id > _least OR (id IS NULL AND _least IS NOT NULL)"
    )
    return later.distinct().select(
        run.alias("run"), F.lit(COPY).alias("kind"), "id", F.lit(0).alias("part"), F.col("key").alias("data")
    )


# Kinds of rows that go beside the texts of a run.
COPY, SHARED, HOT, BLOCK, SPANS = range(5)


class Run:
    """The texts of a run in order of key, and the rows beside them."""

    def __init__(self, left, right) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.set_column(1, "id", pc.fill_null(left.column("id"), (1 << 63) - 1))
        left = left.sort_by([("id", "ascending"), ("key", "ascending")]).combine_chunks()
        self.number = left.column("run")[0].as_py() if left.num_rows else None
        self.ids = np.asarray(left.column("id").to_numpy())
        self.keys = left.column("key").to_pylist()
        self.rest = left.column("rest")
        column = pc.fill_null(left.column("text").cast(pa.large_binary()), b"")
        self.texts = column.to_pylist()
        self.beside: dict[int, list] = {}
        kinds, ids = right.column("kind").to_pylist(), right.column("id").to_pylist()
        for kind, owner, data in zip(kinds, ids, right.column("data").to_pylist(), strict=True):
            self.beside.setdefault(kind, []).append((owner, data))
        last = (1 << 63) - 1
        self.copies = {(last if i is None else i, key) for i, key in self.beside.get(COPY, ())}

    def is_copy(self, at: int) -> bool:
        return (int(self.ids[at]), self.keys[at]) in self.copies

    def laid_out(self):
        """Texts that are no copies: their numbers, bytes end to end, and ends."""
        import numpy as np

        own = [i for i in range(len(self.texts)) if not self.is_copy(i)]
        data = b"".join(self.texts[i] for i in own)
        ends = np.cumsum([len(self.texts[i]) for i in own], dtype=np.int64)
        return np.array(own, np.int64), data, ends

    def numbers(self, kind: int, dtype):
        import numpy as np

        parts = [np.frombuffer(data, dtype) for _, data in self.beside.get(kind, ())]
        return np.concatenate(parts) if parts else np.empty(0, dtype)


def _rows(rows: list[tuple]):
    """`run, kind, id, part, data` as a table."""
    import pyarrow as pa

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    names = ["run", "kind", "id", "part", "data"]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _anchors(left, right, parts: int):
    """The anchors of a run, in one row for each part of the hashes."""
    import numpy as np

    from postlens.llm import suffixes

    run = Run(left, right)
    own, data, ends = run.laid_out()
    if not len(own):
        return _rows([])
    found = suffixes.segments(np.frombuffer(data, np.uint8), ends)
    hashes, marks = suffixes.anchor_counts(found, run.ids[own])
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    heads = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for p in np.unique(part).tolist():
        here = order[heads[p] : heads[p + 1]]
        rows.append((run.number, SHARED, len(here), p, hashes[here].tobytes() + marks[here].tobytes()))
    return _rows(rows)


def _shared(table):
    """Of one part of the hashes: those that texts of several keys have, back to their runs."""
    import numpy as np

    from postlens.llm import suffixes

    parts = []
    columns = (table.column(name).to_pylist() for name in ("run", "id", "data"))
    for run, count, data in zip(*columns, strict=True):
        hashes = np.frombuffer(data, np.uint64, count)
        parts.append((run, hashes, np.frombuffer(data, np.uint16, count, 8 * count)))
    rows = []
    for run, hashes, hot in suffixes.repeated(parts):
        rows.append((run, SHARED, None, 0, hashes.tobytes()))
        if hot.any():
            rows.append((run, HOT, None, 0, hashes[hot].tobytes()))
    return _rows(rows)


def _sorted(left, right, parts: int):
    """A run's sorted suffixes, front-coded, in one row for each range of hashes."""
    import numpy as np

    from postlens.llm import suffixes

    run = Run(left, right)
    own, data, ends = run.laid_out()
    shared = np.sort(run.numbers(SHARED, np.uint64))
    if not len(own) or not len(shared):
        return _rows([])
    found = suffixes.segments(np.frombuffer(data, np.uint8), ends)
    found = found[:, np.isin(found[4].view(np.uint64), shared)]
    hot = np.isin(found[4].view(np.uint64), run.numbers(HOT, np.uint64))
    ids = run.ids[own].tolist()
    entries, spans = suffixes.sorted_run(suffixes.entries(data, ends, found, hot), ids)
    rows, first = [], 0
    of = [int.from_bytes(key[:8], "big") * parts >> 64 for key, _ in entries]
    for at in range(1, len(entries) + 1):
        if at == len(entries) or of[at] != of[first]:
            rows.append((run.number, BLOCK, None, of[first], suffixes.front_coded(entries[first:at])))
            first = at
    if spans:
        data = np.array(spans, np.int64)
        rows.append((run.number, SPANS, None, run.number, data.tobytes()))
    return _rows(rows)


def _merged(table):
    """The covered spans of one range of hashes, back to their runs; others pass through."""
    import numpy as np

    from postlens.llm import suffixes

    runs, blocks, rows = [], [], []
    columns = (table.column(name).to_pylist() for name in ("run", "kind", "data"))
    for run, kind, data in zip(*columns, strict=True):
        if kind == BLOCK:
            runs.append(run)
            blocks.append(data)
        else:
            rows.append((run, SPANS, None, 0, data))
    spans: dict[int, list[int]] = {}
    for block, *span in suffixes.covered(blocks):
        spans.setdefault(block, []).extend(span)
    for block, flat in spans.items():
        found = suffixes.joined_spans(np.array(flat, np.int64).reshape(-1, 3))
        rows.append((runs[block], SPANS, None, 0, found.tobytes()))
    return _rows(rows)


def _widened(data: bytes, start: int, end: int) -> tuple[int, int]:
    """A span of UTF-8 bytes, with the rest of the characters at its borders."""
    while 0 < start < len(data) and data[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def _cut(left, right, whole: bool):
    """What is left of each text of a run."""
    import numpy as np
    import pyarrow as pa

    from postlens.llm import suffixes

    run = Run(left, right)
    own, _, _ = run.laid_out()
    spans = suffixes.joined_spans(run.numbers(SPANS, np.int64).reshape(-1, 3))
    of: dict[int, list[tuple[int, int]]] = {}
    for at, start, end in spans.tolist():
        of.setdefault(int(own[at]), []).append((start, end))
    columns: list[list] = [[], [], [], [], []]
    last = (1 << 63) - 1
    for at, data in enumerate(run.texts):
        if run.is_copy(at) and len(data) >= suffixes.LENGTH:
            of[at] = [(0, len(data))]
        kept, done = [], 0
        for start, end in of.get(at, ()):
            if whole:
                start, end = _widened(data, start, end)
            kept.append(data[done:start])
            done = max(done, end)
        kept.append(data[done:])
        rest = b"".join(kept)
        owner = int(run.ids[at])
        row = (None if owner == last else owner, len(data), len(data) - len(rest), len(of.get(at, ())), rest)
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "rest"]
    counts = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.table([*counts, run.rest], names)
