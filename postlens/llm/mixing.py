"""Mix sources to target weights by hash thresholds.

Each source takes whole copies of all its documents and one further copy of those whose
hash lies below a threshold. The threshold comes from histograms of sizes by hash
bucket: the bucket in which the budget runs out is split again, by the next bits of the
hash, until it holds one hash value. Nothing is sorted, and after the first histogram
only rows of one bucket per source are looked at.

The document at the threshold may be long and leave much of the budget. So further
thresholds follow: from the last one on, documents that fit in what is left are taken in the
same way. At the end one more is taken, that whose size is nearest to what is still left, if
the source ends nearer to its target with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import words
from postlens.sizing import fits_broadcast, measure
from postlens.workspace import new_folder

HASH_BITS = 60
LEVEL_BITS = 12  # 4,096 buckets a source and level, five levels

# Thresholds of a source, one after the other.
PASSES = 4


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def row_hash(key: Column, text: Column) -> Column:
    """The hash a row is taken by: of its key and text, so that others of its key differ."""
    return key_hash(key, F.md5(F.coalesce(text, F.lit(""))))


def key_hash(*keys: Column) -> Column:
    """60 bits of the MD5 of the keys' printed forms, the same on every run."""
    printed = F.concat_ws("\x1f", *(F.coalesce(key.cast("string"), F.lit("")) for key in keys))
    return F.conv(F.substring(F.md5(printed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(
    sources: DataFrame,
    weights: Sequence[float],
    share: float,
    most: float,
) -> DataFrame:
    """`source, source_size` with `target`: shares by weight, none above `most` sizes.

    Sources by code point, NULL last, get the weights in turn. Were no source full, each
    would get `budget * weight / all weights`; a full one stops at `most * source_size`
    and what it leaves goes to the others by weight. That is a water level: sources fill
    in the order of cap over weight, so running sums over the sources (one row each)
    give the level at which the budget is used up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit(list(map(float, weights)))
    ranked = sources.withColumn("_w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "_left": F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_rest": F.sum("_w").over(from_here),
        }
    ).withColumn("_level", F.col("_left") / F.col("_rest"))
    # The first source in filling order that the level does not fill sets it for the rest.
    open_here = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.first(open_here, ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.coalesce(level * F.col("_w"), F.col("_cap")), F.col("_cap"))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents, and for each source its target, whole copies and threshold.

    Sizes are counted once and written to the shared folder, without texts; all histograms
    read them from there.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        row_hash(F.col(key), F.col(text)).alias("_hash"),
    )
    folder = new_folder(spark, "mixing")
    narrow.write.parquet(folder)
    narrow = spark.read.parquet(folder)
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("_full", F.coalesce(full, F.lit(0)).cast("bigint"))
    budget = F.floor(F.col("target") - F.col("_full") * F.col("source_size")).cast("bigint")
    return narrow, _thresholds(narrow, targets.withColumn("_budget", budget))


def with_copies(rows: DataFrame, plan: DataFrame, source: str, hashed: Column, size: Column) -> DataFrame:
    """`rows` with the columns of `plan` and `copies`, how often the mix takes the row."""
    plan = plan.withColumnRenamed("source", "_source")
    extra = F.when(_within(hashed, size) | F.coalesce(hashed == F.col("_one"), F.lit(False)), 1).otherwise(0)
    return (
        rows.join(_small(plan), rows[source].eqNullSafe(F.col("_source")))
        .withColumn("copies", (F.col("_full") + extra).cast("bigint"))
        .drop("_source", "_full", "_upto", "_fits", "_one")
    )


def _within(hashed: Column, size: Column) -> Column:
    """Whether a row is below its source's thresholds."""
    found = F.when(hashed < F.get("_upto", 0), F.lit(True))
    for k in range(1, PASSES):
        found = found.when(hashed < F.get("_upto", k), size <= F.get("_fits", k))
    return found.otherwise(F.lit(False))


def mix(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """One row per document: `key`, `source`, `size`, `source_size`, `target`, `copies`, `taken`.

    `taken` is `copies * size`. A document is taken `floor(target / source_size)` times,
    and once more while the running size of its source, in hash order, stays within the
    rest of the target; from the first that does not fit on, those no longer than what is
    left go on, four times in all. Of the others the one whose size is nearest to what is then
    left, of equal ones that of least hash, is taken if the target is nearer with it. So no
    single further document would bring a source nearer. The hash is of key and text, so reruns agree; rows that
    repeat both are taken alike. NULL sources form one source; NULL and empty texts have size 0 and take no
    budget. Sources of total size 0 have target 0 and no copies. An empty table gives an
    empty table. `how`: see `plan_mix`.
    """
    narrow, plan = plan_mix(docs, key=key, **how)
    return with_copies(narrow, plan, "source", F.col("_hash"), F.col("size")).select(
        F.col("key").alias(key),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them. Texts are not shuffled.

    Texts of size 0 come as often as their hash says, like any other. All columns are
    carried on, whatever their names.
    """
    _, plan = plan_mix(docs, key=key, text=text, source=source, **how)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source).alias("_in"))
    hashed = row_hash(F.col("_row")[key], F.col("_row")[text])
    taken = with_copies(rows, plan, "_in", hashed, word_count(F.col("_row")[text]))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return taken.where("copies > 0").withColumn("_time", times).select("_row.*")


def _small(table: DataFrame) -> DataFrame:
    """Broadcast one row per source if they measure up to the limit; else left to the planner."""
    return F.broadcast(table) if fits_broadcast(measure(table)) else table


def _thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """`targets` with `_upto` and `_fits`, the thresholds of each pass and their size limits, and `_one`.

    In pass k rows are in whose hash lies below `_upto[k]`, but not below the one before,
    and whose size is at most `_fits[k]`. `_one` is the hash of one row more, or NULL.
    """
    state = targets.withColumns({"_from": F.lit(0).cast("bigint"), "_fit": F.lit(2**62).cast("bigint")})
    bigints = F.array().cast("array<bigint>")
    state = state.withColumns({"_upto": bigints, "_fits": bigints})
    for _ in range(PASSES):
        state = _pass(narrow, state)
        state = state.withColumns(
            {
                "_upto": F.array_append("_upto", F.col("_threshold")),
                "_fits": F.array_append("_fits", F.col("_fit")),
            }
        ).withColumns({"_from": F.col("_threshold"), "_fit": F.col("_budget")})
    state = state.drop("_from", "_fit", "_threshold")
    folder = new_folder(narrow.sparkSession, "mixing-level")
    state.write.parquet(folder)
    state = narrow.sparkSession.read.parquet(folder)
    edge = _small(state.select(F.col("source").alias("_s"), "_upto", "_fits", "_budget"))
    away = F.abs(F.col("size") - F.col("_budget"))
    others = narrow.join(edge, F.col("source").eqNullSafe(F.col("_s"))).where(
        ~_within(F.col("_hash"), F.col("size")) & (away < F.col("_budget"))
    )
    nearest = others.groupBy("_s").agg(F.min(F.struct(away.alias("away"), "_hash")).alias("one"))
    nearest = nearest.select(F.col("_s").alias("_of"), F.col("one._hash").alias("_one"))
    # Rows that share the hash are taken together; they may be too much.
    shared = others.join(_small(nearest), F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_one")))
    shared = shared.groupBy("_s", "_one", "_budget").agg(F.sum("size").alias("_sum"))
    nearer = shared.where(F.abs(F.col("_sum") - F.col("_budget")) < F.col("_budget")).select("_s", "_one")
    state = state.join(_small(nearer), F.col("source").eqNullSafe(F.col("_s")), "left")
    return state.drop("_s", "_budget")


def _pass(narrow: DataFrame, state: DataFrame) -> DataFrame:
    """`state` with `_threshold` and what is left of `_budget`, from rows in question.

    Those are the rows with a hash of `_from` or more and a size of at most `_fit`. At each
    level those of the boundary bucket are added up by the next bits of their hash; running
    sums over at most 4,096 buckets a source tell which bucket the budget ends in. All
    buckets before it are in; its own rows go to the next level.
    """
    spark = narrow.sparkSession
    state = state.withColumn("_threshold", F.col("_from"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        folder = new_folder(spark, "mixing-level")
        state.write.parquet(folder)
        state = spark.read.parquet(folder)
        edge = _small(state.select(F.col("source").alias("_s"), "_threshold", "_from", "_fit"))
        inside = narrow.join(edge, F.col("source").eqNullSafe(F.col("_s"))).where("_hash >= _from AND size <= _fit")
        # On the first level every bucket is in question.
        same = F.shiftright("_hash", shift + LEVEL_BITS) == F.shiftright("_threshold", shift + LEVEL_BITS)
        inside = inside if shift + LEVEL_BITS == HASH_BITS else inside.where(same)
        sums = inside.groupBy("source", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("size").alias("_size")
        )
        running = Window.partitionBy("source").orderBy("_bucket")
        sums = sums.withColumn("_so_far", F.sum("_size").over(running))
        joined = state.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        within = F.col("_so_far") <= F.col("_budget")
        state = joined.groupBy(*state.columns).agg(
            F.coalesce(F.max(F.when(within, F.col("_so_far"))), F.lit(0)).alias("_used"),
            F.min(F.when(~within, F.col("_bucket"))).alias("_edge"),
            F.max("_bucket").alias("_last"),
        )
        # No bucket overflows: all of them are in, and nothing is left to split.
        start = F.when(F.col("_edge").isNotNull(), F.shiftleft("_edge", shift)).when(
            F.col("_last").isNotNull(), F.shiftleft(F.col("_last") + 1, shift)
        )
        state = (
            state.withColumn("_threshold", F.coalesce(start, F.col("_threshold")).cast("bigint"))
            .withColumn("_budget", F.col("_budget") - F.col("_used"))
            .drop("_used", "_edge", "_last")
        )
    return state
