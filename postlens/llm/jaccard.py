"""Near-duplicate join on word n-grams: MinHash bands, then exact verification.

Each distinct text gets a MinHash signature, cut into bands; numbers of bands and rows
are chosen for a target recall at the threshold. Band hashes are shuffled, and texts that
share one are joined up into candidate clusters. Within a cluster the whole n-gram sets
of all pairs are compared, block by block, so that a cluster of any size is spread over
tasks and only counts and spanning links leave them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import free_prefix, importable
from postlens.llm.graph import components
from postlens.workspace import new_folder

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 192

# Texts of a cluster that are compared with each other at a time, on average.
BLOCK = 200


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows: as many rows as `most` hashes allow at this recall.

    A pair of similarity s shares one of b bands of r rows with probability
    1 - (1 - s^r)^b; more rows mean fewer dissimilar candidates.
    """
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at {threshold}")
    return best


def text_key(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text; NULL counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _texts(column):
    """Bytes and ends of the strings of an Arrow column."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[1:] - ends[0]


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """`key, band` with one row per distinct text, band and band hash; `docs`: `key, text`."""
    importable(docs.sparkSession)

    def batches(stream: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from postlens.llm.shingles import mixed, numbers, shingle_hashes, steps

        factor, shift = numbers(bands * rows, 11), numbers(bands * rows, 12)
        row_factor, band_shift = numbers(rows, 13), numbers(bands, 14)
        for batch in stream:
            data, ends = _texts(batch.column(1))
            lengths = np.diff(ends, prepend=0)
            for first, last in steps(lengths):
                begin = ends[first] - lengths[first]
                hashes, counts = shingle_hashes(data[begin : ends[last - 1]], ends[first:last] - begin, width)
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                starts = (np.cumsum(counts) - counts)[some]
                found = np.empty((bands, len(some)), np.uint64)
                for band in range(bands):
                    total = np.full(len(some), band_shift[band])
                    for row in range(rows):
                        k = band * rows + row
                        least = np.minimum.reduceat(hashes * factor[k] + shift[k], starts)
                        total += mixed(least) * row_factor[row]
                    found[band] = mixed(total)
                keys = batch.column(0).take(pa.array(some + first))
                ends32 = np.arange(0, bands * len(some) + 1, bands, dtype=np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends32), pa.array(found.T.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([keys, lists], ["key", "bands"])

    found = docs.select("key", "text").mapInArrow(batches, "key binary, bands array<bigint>")
    return found.select("key", F.explode("bands").alias("band")).distinct()


def candidate_clusters(bands: DataFrame) -> DataFrame:
    """`node, root` of texts that share a band with another, directly or through others."""
    folder = new_folder(bands.sparkSession, "bands")
    bands.write.parquet(folder)
    bands = bands.sparkSession.read.parquet(folder)
    shared = bands.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("_m")).where("b != _m")
    edges = bands.join(shared.drop("_m"), "band").select(F.col("key").alias("a"), "b").distinct()
    return components(edges)


def _sets(members: DataFrame, width: int) -> DataFrame:
    """`key, root, blocks, grams`: sorted 64-bit n-gram hashes of each text, as bytes."""

    def batches(stream: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from postlens.llm.shingles import shingle_hashes, steps

        for batch in stream:
            data, ends = _texts(batch.column(3))
            lengths = np.diff(ends, prepend=0)
            sets: list[bytes] = []
            for first, last in steps(lengths):
                begin = ends[first] - lengths[first]
                hashes, counts = shingle_hashes(data[begin : ends[last - 1]], ends[first:last] - begin, width)
                for own in np.split(hashes, np.cumsum(counts)[:-1]):
                    sets.append(np.unique(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sets, pa.binary())], ["key", "root", "blocks", "grams"]
            )

    schema = "key binary, root binary, blocks int, grams binary"
    return members.select("key", "root", "blocks", "text").mapInArrow(batches, schema)


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """`key, links, other` from block pairs: partial link counts, and a spanning forest.

    Rows come sorted by (root, low, high); a task holds one pair of blocks at a time.
    """

    def batches(stream: Iterator) -> Iterator:
        import pyarrow as pa

        from postlens.llm.blocks import linked

        held, rows = None, []
        names = ["key", "links", "other"]

        def out(found):
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        ready = []
        for batch in stream:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[:3] != held:
                    if rows:
                        ready += linked(*held[1:], rows, threshold)
                    held, rows = row[:3], []
                    if len(ready) > 5000:
                        yield out(ready)
                        ready = []
                rows.append(row[3:])
        if rows:
            ready += linked(*held[1:], rows, threshold)
        yield out(ready)

    columns = ["root", "low", "high", "key", "block", "grams"]
    return pairs.select(*columns).mapInArrow(batches, "key binary, links bigint, other binary")


def _text_classes(
    docs: DataFrame, key: str, text: str, width: int, threshold: float, recall: float, hashes: int
) -> tuple[DataFrame, DataFrame]:
    """`id, key, text` of every row, `key` being the text's digest, and a row for each text.

    The latter has `key`, its class's `root`, the least id of the class, `copy_id`,
    `n_copies` and `n_links`.
    """
    spark = docs.sparkSession
    importable(spark)
    bands, rows = choose_bands(threshold, recall, hashes)
    texts = docs.select(
        F.col(key).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text")
    )
    classes = texts.groupBy("key").agg(F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"))
    clusters = candidate_clusters(signatures(texts, width, bands, rows))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = clusters.withColumnRenamed("node", "key").join(sizes, "root").join(classes, "key")
    first = (texts["key"] == members["key"]) & texts["id"].eqNullSafe(members["copy_id"])
    sets = _sets(
        texts.join(members, first).select(texts["key"], "root", "blocks", texts["text"]), width
    )
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("block", block).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    pairs = pairs.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})
    pairs = pairs.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    folder = new_folder(spark, "links")
    _compared(pairs, threshold).write.parquet(folder)
    links = spark.read.parquet(folder)
    counts = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    forest = links.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))
    roots = components(forest).select(F.col("node").alias("key"), "root")
    joined = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    return texts, joined.join(least, "root").join(counts, "key", "left")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
) -> DataFrame:
    """One row per row of `docs`: `key`, `class_id`, `copy_id`, `n_copies`, `n_links`.

    Two different texts are linked if the Jaccard similarity of their sets of `width`-word
    windows reaches `threshold`. `n_links` counts the different texts linked to this one,
    `copy_id` is the least key among rows of the same text and `n_copies` their number;
    `class_id` is the least key of all rows that links and equal texts join together. Other
    columns of `docs` are ignored. Long texts are compared whole. An empty table gives an
    empty table.

    Texts of fewer words have one window of all their words. NULL and empty texts are one
    text without windows, linked to none. NULL keys are never least. Repeated rows are
    copies. Pairs at the threshold are missed with a probability of at most `1 - recall`;
    every pair of a candidate cluster is compared, whatever its size.
    """
    texts, joined = _text_classes(docs, key, text, width, threshold, recall, hashes)
    # Written, so that what is joined are two plain shuffles, of which Spark splits the hot
    # partitions of a text with very many copies.
    folder = new_folder(docs.sparkSession, "text-classes")
    joined.write.parquet(folder)
    joined = docs.sparkSession.read.parquet(folder)
    return (
        texts.select("id", "key")
        .join(joined, "key")
        .select(
            F.col("id").alias(key),
            "class_id",
            "copy_id",
            "n_copies",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class: that of least key, NULL last, and of those the least digest.

    Of rows that repeat both key and text one stays; which one is settled when they are
    numbered in a written table. All columns are carried on, whatever their names. An empty table
    gives an empty table.
    """
    options = {"width": WIDTH, "threshold": THRESHOLD, "recall": RECALL, "hashes": HASHES} | how
    _, classes = _text_classes(docs, key, text, **options)
    least = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "key")).alias("one")
    p = free_prefix(docs)
    folder = new_folder(docs.sparkSession, "survivors")
    chosen = classes.groupBy("root").agg(least)
    chosen.select(F.col("one.key").alias(f"{p}key"), F.col("one.copy_id").alias(f"{p}id")).write.parquet(folder)
    chosen = docs.sparkSession.read.parquet(folder)
    own = (text_key(docs[text]) == F.col(f"{p}key")) & docs[key].eqNullSafe(F.col(f"{p}id"))
    rows = docs.join(chosen, own).select(*(docs[c] for c in docs.columns), f"{p}key")
    repeats = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias(f"{p}key")).groupBy("id", f"{p}key")
    repeats = repeats.count().where("count > 1").join(chosen, f"{p}key", "left_semi")
    if repeats.isEmpty():
        return rows.drop(f"{p}key")
    # Rows are numbered, and the numbers kept in a table, so that one of each can be named.
    folder = new_folder(docs.sparkSession, "numbered")
    rows.withColumn(f"{p}row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    first = rows.groupBy(f"{p}key").agg(F.min(f"{p}row").alias(f"{p}row"))
    return rows.join(first.select(f"{p}row"), f"{p}row", "left_semi").select(*docs.columns)
