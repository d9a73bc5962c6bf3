"""Order MinHash fingerprints of texts.

The k-mers of a text, here `K` words, are numbered by occurrence, so that repeats differ,
and hashed. The hash space is a ring, divided into bins. From the beginning of each bin on,
the two k-mers of least hash are selected, put back into the order of the text, and hashed as
a pair: the fingerprint changes where k-mers are replaced, and also where they change
places. A short text leaves bins with one k-mer or none; their pairs reach into the bins
that follow, the first after the last, so that every pair of two k-mers has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import words
from postlens.workspace import new_folder

K = 3
TUPLE = 2  # the k-mers of a pair
BIN_BITS = 6
BINS = 1 << BIN_BITS

# The number of a bin without k-mers.
EMPTY = 0


def _bin(hashed: Column) -> Column:
    return F.shiftright(hashed, 64 - BIN_BITS).cast("int")


def _places(size: Column) -> Column:
    """0 to size - 1."""
    none = F.array().cast("array<int>")
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(none)


def _by_bin(of_bins: str, kind: str) -> Column:
    """The values of a map by bin as an array over all bins, NULL where it has none.

    A column that only a lambda reads would be computed anew for every element, since the
    optimiser puts its expression there; a second use, here of its size, prevents that.
    """
    numbers = F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1))
    found = F.transform(numbers, lambda b: F.try_element_at(of_bins, b))
    nothing = F.transform(numbers, lambda b: F.lit(None))
    return F.when(F.size(of_bins) > 0, found).otherwise(nothing.cast(kind))


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, an array with a 32-bit number for each bin, all within the row.

    Near its end a text has k-mers of fewer words, so that short texts have some too. A
    text without words has only empty bins; of one with a single k-mer all bins are its
    hash. NULL counts as empty. Equal texts have equal fingerprints.
    """
    step = docs.withColumn("_w", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    w = F.col("_w")
    kmers = F.transform(w, lambda h, i: F.xxhash64(h, *(F.get(w, i + j) for j in range(1, K))))
    step = step.withColumn("_h", kmers).drop("_w")
    step = _with_occurrences(step)
    step = step.withColumn("_s", F.sort_array("_n"))
    s = F.col("_s")
    first = lambda i: (i == 0) | (_bin(F.get(s, i)) != _bin(F.get(s, i - 1)))
    step = step.withColumn("_heads", F.filter(_places(F.size(s)), first))

    def limit(head: Column) -> Column:
        """The greatest hash selected of the bin that begins here."""
        found = [F.get(s, head + j) for j in range(TUPLE)]
        same = [F.when(_bin(x) == _bin(found[0]), x) for x in found]
        return F.coalesce(*reversed(same))

    limits = F.map_from_arrays(
        F.transform("_heads", lambda i: _bin(F.get(s, i))), F.transform("_heads", limit)
    )
    step = step.withColumn("_limits", limits).drop("_heads", "_s")
    step = step.withColumn("_limits", _by_bin("_limits", "array<bigint>"))
    n = F.col("_n")
    selected = lambda i: F.get(n, i) <= F.get("_limits", _bin(F.get(n, i)) + BINS // 2)
    picked = F.when(F.size("_limits") > 0, F.filter(_places(F.size(n)), selected))
    step = step.withColumn("_at", picked).drop("_limits")
    chosen = F.transform(
        "_at", lambda i: F.struct(_bin(F.get(n, i)).alias("b"), i.alias("i"), F.get(n, i).alias("h"))
    )
    step = step.withColumn("_c", F.sort_array(chosen)).drop("_at", "_n")
    c = F.col("_c")
    begins = lambda i: (i == 0) | (F.get(c, i)["b"] != F.get(c, i - 1)["b"])
    step = step.withColumn("_heads", F.filter(_places(F.size(c)), begins))

    def pair_hash(head: Column, j: Column) -> Column:
        """The pair that begins with the bin at `head`, the j-th filled one, but `EMPTY`."""
        one, two = F.get(c, head), F.get(c, head + 1)
        after = F.get("_heads", (j + 1) % F.size("_heads"))
        low, high = F.get(c, after), F.get(c, after + 1)
        least = F.when((high["b"] == low["b"]) & (high["h"] < low["h"]), high).otherwise(low)
        # One k-mer in the bin: the other is the least of the next filled bin, if there is one.
        lone = F.when(after == head, F.xxhash64(one["h"])).when(
            one["i"] < least["i"], F.xxhash64(one["h"], least["h"])
        ).otherwise(F.xxhash64(least["h"], one["h"]))
        pair = F.when(two["b"] == one["b"], F.xxhash64(one["h"], two["h"])).otherwise(lone)
        number = F.pmod(pair, F.lit(2**32 - 1)) - 2**31 + 1
        return F.when(number == EMPTY, F.lit(2**31 - 1)).otherwise(number).cast("int")

    hashes = F.map_from_arrays(
        F.transform("_heads", lambda i: F.get(c, i)["b"]), F.transform("_heads", pair_hash)
    )
    step = step.withColumn("_hashes", hashes).drop("_heads", "_c")
    step = step.withColumn("_filled", F.map_keys("_hashes"))

    def of_bin(b: Column) -> Column:
        """The pair of a bin, or of the first filled one that follows it."""
        following = F.coalesce(F.get(F.filter("_filled", lambda x: x > b), 0), F.get("_filled", 0))
        return F.coalesce(F.try_element_at("_hashes", b), F.try_element_at("_hashes", following))

    numbers = F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1))
    whole = F.when(F.size("_filled") > 0, F.transform(numbers, of_bin))
    nothing = F.transform(numbers, lambda b: F.lit(EMPTY))
    return step.withColumn(out, F.coalesce(whole, nothing)).drop("_hashes", "_filled")


def _with_occurrences(step: DataFrame) -> DataFrame:
    """`_h` as `_n`: the hash of a k-mer's first occurrence is kept, later ones differ.

    Only where a k-mer repeats are they sorted with their places, so that equal ones are
    neighbours and a place within them is the number of the occurrence.
    """
    h = F.col("_h")
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    some = F.size(F.array_distinct(h)) < F.size(h)
    step = step.withColumn("_r", F.when(some, F.sort_array(pairs)).otherwise(none))
    r = F.col("_r")
    first = lambda i: (i == 0) | (F.get(r, i)["h"] != F.get(r, i - 1)["h"])
    step = step.withColumn("_b", F.filter(_places(F.size(r)), first))
    b = F.col("_b")

    def of_one(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get(b, i + 1), F.size(r))
        return F.transform(
            F.sequence(begin, end - 1),
            lambda at: F.struct(
                F.get(r, at)["i"].alias("i"),
                F.when(at == begin, F.get(r, at)["h"])
                .otherwise(F.xxhash64(F.get(r, at)["h"], at - begin))
                .alias("h"),
            ),
        )

    step = step.withColumn("_o", F.sort_array(F.flatten(F.transform(b, of_one)))).drop("_r", "_b")
    numbered = F.when(F.size("_o") > 0, F.transform("_o", lambda x: x["h"])).otherwise(h)
    return step.withColumn("_n", numbered).drop("_o", "_h")


def likeness(left: Column, right: Column) -> Column:
    """The share of equal bins among those filled in either; 1 if none is."""
    both = F.zip_with(
        left,
        right,
        lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)),
    )
    filled, equal = F.size(F.filter(both, lambda x: x > 0)), F.size(F.filter(both, lambda x: x > 1))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def printed(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each bin."""
    digits = lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(2**32 - 1))), 8, "0")
    return F.array_join(F.transform(fingerprint, digits), "")


def with_successors(keyed: DataFrame) -> DataFrame:
    """`row, previous, id, need, repeated` for distinct rows `row, id, n_chars`: who each follows.

    The order is by falling `id`, NULL last, then by `row`; the first row follows the last.
    `id` and `need`, half of its characters, are those of the previous row, and `repeated` says
    whether the row itself came more than once. Rows are dealt by ranges and numbered
    within each; what passes between ranges is the first row of each.
    """
    spark = keyed.sparkSession
    order = [F.col("id").desc_nulls_last(), F.col("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "order")
    keyed = keyed.groupBy("row", "id", "n_chars").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    keyed.repartitionByRange(parts, *order).withColumn(
        "part", F.spark_partition_id()
    ).write.parquet(folder)
    ranged = spark.read.parquet(folder)
    window = Window.partitionBy("part").orderBy(*order)
    ranged = ranged.withColumns(
        {
            "_next": F.lead(F.struct("row", "repeated")).over(window),
            "_first": F.row_number().over(window) == 1,
        }
    )
    folder = new_folder(spark, "order-next")
    ranged.write.parquet(folder)
    ranged = spark.read.parquet(folder)
    # One row per range: its first row, and where the range before it goes on.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranged.where("_first").select("part", F.struct("row", "repeated").alias("_row"))
    after = F.coalesce(F.lead("_row").over(Window.orderBy("part")), F.first("_row").over(whole))
    linked = ranged.join(F.broadcast(firsts.select("part", after.alias("_after"))), "part")
    following = F.coalesce("_next", "_after")
    return linked.select(
        following["row"].alias("row"),
        following["repeated"].alias("repeated"),
        F.col("row").alias("previous"),
        "id",
        F.floor(F.col("n_chars") / 2).cast("int").alias("need"),
    )


def _any_repeated(order: DataFrame) -> bool:
    return not order.where("repeated").isEmpty()


def row_key(*columns: Column) -> Column:
    """16 bytes that name a row by its values."""
    marked = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    return F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *marked), 256)), 1, 16)


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next row.

    The edited text has the last half of its characters (rounded down) replaced by the first
    as many, or all there are, of the next row's text in the order of `with_successors`.
    Returned are `key`, `n_chars`, `edited`, the fingerprints `fingerprint` and
    `edited_fingerprint` as arrays, and the likenesses `near_edited` and `near_next`.

    NULL texts count as empty. Rows that repeat key and text count once in the order and
    come out as often as they went in. A single row follows itself. Whole texts are
    shuffled once, and the pieces that replace others once.
    """
    texts = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("row", row_key(F.col("id"), F.col("text")))
    order = with_successors(texts.select("row", "id", F.length("text").alias("n_chars")))
    # Both joins read the same columns, so that texts are fingerprinted and shuffled once.
    texts = with_fingerprint(texts.select("row", "text"), "text", "fingerprint")
    pieces = texts.join(order, "row").select(
        F.col("previous").alias("row"),
        "id",
        "repeated",
        F.substr("text", F.lit(1), F.col("need")).alias("piece"),
        F.col("fingerprint").alias("next"),
    )
    # A row that came more than once gave its piece as often; the others need no grouping.
    again = pieces.where("repeated").dropDuplicates(["row"])
    pieces = pieces.where("NOT repeated").union(again) if _any_repeated(order) else pieces
    half = F.length("text") - F.floor(F.length("text") / 2)
    edited = F.concat(F.substr("text", F.lit(1), half.cast("int")), "piece")
    joined = texts.join(pieces, "row").select(
        "id",
        F.length("text").cast("bigint").alias("n_chars"),
        edited.alias("edited"),
        "fingerprint",
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
    done = with_fingerprint(joined, "edited", "edited_fingerprint")
    return done.withColumn(
        "near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    ).withColumnRenamed("id", key)
