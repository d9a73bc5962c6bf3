"""Quality rules: shape counts, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed. Two multinomials over the hash buckets, one of trusted
texts and one of the whole corpus, give each bucket a log ratio; a document's score is the
mean ratio of its n-grams. The trusted multinomial is smoothed with the corpus, so every
bucket without a trusted n-gram has the same ratio, and only the others need to be counted:
there are as many buckets as the trusted sample asks for, however large the corpus.

A trusted text is scored by the other trusted texts alone, also where it comes again without
a label. The threshold is the one that best parts the labelled rows by these scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import SPACE_RUN, free_prefix, words
from postlens.llm.jaccard import text_key
from postlens.lookup import dense, look_up
from postlens.sizing import fits_broadcast, measure
from postlens.workspace import new_folder

# Keys of labelled documents of either kind that the model is fitted on, at most.
TRUSTED = 2_000

# Buckets for every distinct n-gram of the trusted texts, at least.
ROOM = 8
LEAST_BUCKETS = 1 << 10

# Tables of more buckets, a byte each, are joined with the n-grams instead of looked up.
LOOKED_UP = 1 << 26

# Share of the trusted counts in the smoothed multinomial, and parts of one in a stored ratio.
TRUST = 0.5
PARTS = 16
NEUTRAL = round(PARTS * math.log(1 - TRUST))

# How often a share of good documents lost counts against the same share of bad ones kept.
LOST = 10

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "[^#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_hashes(docs: DataFrame, text: Column, kept: list[str], p: str = "_") -> DataFrame:
    """The columns `kept`, with hashes of words, `one`, and of adjacent pairs, `two`, after `p`.

    The last pair is the last word and the end of the text, so both have an entry per word.
    """
    step = docs.select(*kept, F.transform(words(text), lambda w: F.xxhash64(w)).alias(f"{p}one"))
    one = F.col(f"{p}one")
    return step.withColumn(f"{p}two", F.transform(one, lambda h, i: F.xxhash64(h, F.get(one, i + 1))))


def with_shape(step: DataFrame, text: Column, p: str) -> DataFrame:
    """Adds the counts of shape, named with `p` in front, within each row.

    Windows of three words are compared by 64-bit hashes. Sorted with their positions,
    equal ones are neighbours; the positions kept then cover words up to the next one.
    The two windows that run over the end of the text equal no other.
    """
    one, two = F.col(f"{p}one"), F.col(f"{p}two")
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumns(
        {
            f"{p}threes": F.transform(two, lambda x, i: F.xxhash64(x, F.get(one, i + 2))),
            f"{p}lines": lines,
            f"{p}n_words": F.size(one).cast("bigint"),
            f"{p}word_chars": F.length(F.regexp_replace(filled, SPACE_RUN, "")).cast("bigint"),
            f"{p}n_symbols": F.length(F.regexp_replace(filled, SYMBOLS, "")).cast("bigint"),
        }
    )
    w = F.col(f"{p}threes")
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    some = F.size(F.array_distinct(w)) < F.size(w)
    none = F.array().cast("array<struct<w:bigint,i:int>>")
    repeated_lines = F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))
    step = step.withColumns(
        {
            f"{p}sorted": F.when(some, placed).otherwise(none),
            f"{p}n_dup_lines": repeated_lines.cast("bigint"),
        }
    ).drop(f"{p}threes", f"{p}lines")
    s = F.col(f"{p}sorted")
    twice = F.filter(
        s,
        lambda x, i: F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))
        | F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)),
    )
    step = step.withColumn(f"{p}at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop(f"{p}sorted")
    at = F.col(f"{p}at")
    covered = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return step.withColumn(f"{p}n_repeat_words", total).drop(f"{p}at")


def _bounded(labels: DataFrame, key: str, most: int) -> DataFrame:
    return labels.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)


def trusted_ids(labels: DataFrame, key: str = "doc_id", most: int = TRUSTED) -> DataFrame:
    """Keys of documents labelled good and not toxic, at most `most` of them.

    The bound keeps the sample small whatever the number of labels; which are taken
    depends on a hash of the key, not on their order.
    """
    good = labels.where(f"quality = 1 AND coalesce(toxic, 0) = 0 AND {key} IS NOT NULL")
    return _bounded(good, key, most)


def rejected_ids(labels: DataFrame, key: str = "doc_id", most: int = TRUSTED) -> DataFrame:
    """Keys of documents labelled bad, bounded like `trusted_ids`."""
    return _bounded(labels.where(f"quality = 0 AND {key} IS NOT NULL"), key, most)


@dataclass(frozen=True)
class Model:
    """What is known of the buckets, where it is kept, and the threshold on scores.

    `ratios` has a row `bucket, ratio` for each bucket with trusted n-grams, `table` the
    ratios of all buckets in one row of arrays (None if there are too many buckets), and
    `held` a row `digest, score` for each trusted text, scored by the others.
    """

    buckets: int
    ratios: DataFrame
    table: DataFrame | None
    held: DataFrame
    threshold: float


def best_threshold(good: list[float], bad: list[float]) -> float:
    """The score from which on documents are kept.

    The share of good ones lost counts `LOST` times, that of bad ones kept once, and their sum
    is least. It lies halfway between two scores. Of equal sums the lowest counts. Without
    good scores or without bad ones everything is kept.
    """
    if not good or not bad:
        return -math.inf
    marked = sorted([(x, 1 / len(good), 0.0) for x in good] + [(x, 0.0, 1 / len(bad)) for x in bad])
    lost, kept = 0.0, 1.0
    best, threshold = kept, marked[0][0]
    for at, (x, of_good, of_bad) in enumerate(marked):
        lost, kept = lost + of_good, kept - of_bad
        following = marked[at + 1][0] if at + 1 < len(marked) else math.inf
        if following > x and LOST * lost + kept < best - 1e-12:
            best, threshold = LOST * lost + kept, x + 1e-9 if following == math.inf else (x + following) / 2
    return threshold


def buckets_for(distinct: int) -> int:
    """A power of two, `ROOM` buckets or more for each distinct n-gram of the trusted texts."""
    return max(LEAST_BUCKETS, 1 << max(0, ROOM * distinct - 1).bit_length())


def _written(rows: DataFrame, name: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def ratio(trust: Column, trust_all: Column, raw: Column, raw_all: Column) -> Column:
    """The log ratio of a bucket in parts of one, from its counts and those of all buckets."""
    share = F.coalesce(F.try_divide(trust, trust_all), F.lit(0.0))
    times = F.lit(1 - TRUST) + F.lit(TRUST) * share * raw_all / raw
    return F.least(F.lit(127), F.round(F.lit(PARTS) * F.log(times))).cast("tinyint")


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets).cast("bigint"))


def _grams(step: DataFrame, *kept: str) -> DataFrame:
    return step.select(*kept, F.explode(F.concat("_one", "_two")).alias("gram"))


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of `docs` and `labels` (`key`, `quality`, `toxic`).

    Trusted counts are over the different texts of at most `TRUSTED` keys, corpus counts over
    all rows. The threshold is taken from the scores of trusted and of rejected rows that
    pass the base rules, at most `TRUSTED` keys of each; a key of several rows counts by its
    least score. Without labels everything that passes the base rules is kept. The driver
    gets a score for each of those keys, and a table of at most `LOOKED_UP` bytes.

    NULL texts have no n-grams. Rows with NULL keys are counted, but are never labelled.
    Labels without a document are ignored, as are other columns. Long texts count whole.
    """
    marks = trusted_ids(labels, key).select(F.col(key).alias("_key"), F.lit(True).alias("_good"))
    marks = marks.union(rejected_ids(labels, key).select(F.col(key).alias("_key"), F.lit(False).alias("_good")))
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = _written(narrow.join(F.broadcast(marks), "_key"), "quality-labelled")

    texts = marked.where("_good").groupBy(text_key(F.col("_text")).alias("digest")).agg(F.first("_text").alias("_text"))
    own = _grams(with_hashes(texts, F.col("_text"), ["digest"]), "digest")
    own = _written(own.groupBy("digest", "gram").agg(F.count(F.lit(1)).alias("n")), "quality-grams")
    buckets = buckets_for(own.select("gram").distinct().count())
    own = own.groupBy("digest", bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    trust = _written(own.groupBy("bucket").agg(F.sum("n").alias("trust")), "quality-trust")
    trust_all = F.lit(trust.agg(F.sum("trust")).first()[0] or 0)

    # Corpus counts of the buckets with trusted n-grams; all others are counted as one.
    grams = _grams(with_hashes(narrow, F.col("_text"), [])).select(bucket_of(F.col("gram"), buckets).alias("bucket"))
    if buckets <= LOOKED_UP:
        member = dense(trust.select(F.col("bucket").alias("place"), F.lit(1).cast("tinyint").alias("is")), "is", buckets, 0)
        grams = grams.select(F.when(look_up(member, F.col("bucket"), buckets) == 1, F.col("bucket")).alias("bucket"))
        raw = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"))
    else:
        raw = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw")).join(trust, "bucket", "left")
        raw = raw.groupBy(F.when(F.col("trust").isNotNull(), F.col("bucket")).alias("bucket")).agg(F.sum("raw").alias("raw"))
    raw = _written(raw, "quality-raw")
    raw_all = F.lit(raw.agg(F.sum("raw")).first()[0] or 0)
    counts = _written(trust.join(raw, "bucket"), "quality-counts")
    ratios = counts.select("bucket", ratio(F.col("trust"), trust_all, F.col("raw"), raw_all).alias("ratio"))
    ratios = _written(ratios, "quality-ratios")
    table = dense(ratios.withColumnRenamed("bucket", "place"), "ratio", buckets, NEUTRAL) if buckets <= LOOKED_UP else None

    sizes = own.groupBy("digest").agg(F.sum("n").alias("size"))
    left = ratio(F.col("trust") - F.col("n"), trust_all - F.col("size"), F.col("raw"), raw_all)
    held = own.join(counts, "bucket").join(sizes, "digest").groupBy("digest")
    held = held.agg((F.sum(left * F.col("n")) / F.sum("n") / PARTS).alias("score"))
    model = Model(buckets, ratios, table, _written(held, "quality-held"), -math.inf)
    judged = judge_quality(marked, model, "_text")
    judged = _written(judged.select("_key", "_good", "score", "base_failed"), "quality-scores")
    scores = judged.where("NOT base_failed").groupBy("_key", "_good").agg(F.min("score").alias("score")).collect()
    found = {flag: [r["score"] for r in scores if r["_good"] == flag] for flag in (True, False)}
    return Model(buckets, ratios, table, model.held, best_threshold(found[True], found[False]))


def _judged_texts(docs: DataFrame, model: Model | None, text: str) -> DataFrame:
    """A row for each different text: `digest`, its counts, `size` and `sum` of its ratios."""
    narrow = docs.select(F.col(text).alias("_text"), text_key(F.col(text)).alias("digest"))
    step = with_shape(with_hashes(narrow, F.col("_text"), ["digest", "_text"]), F.col("_text"), "_")
    counts = [f"_{name}" for name in COUNTS]
    grams = step.select("digest", *counts, F.explode_outer(F.concat("_one", "_two")).alias("gram"))
    if model is None:
        grams = grams.withColumn("ratio", F.lit(0))
    else:
        bucket = bucket_of(F.col("gram"), model.buckets)
        if model.table is not None:
            grams = grams.withColumn("ratio", look_up(model.table, bucket, model.buckets))
        else:
            grams = grams.withColumn("bucket", bucket).join(model.ratios, "bucket", "left")
    # Equal texts have equal sums, so that of all their rows has the same mean.
    found = grams.groupBy("digest").agg(
        *(F.max(name).alias(name) for name in counts),
        F.count("gram").alias("size"),
        F.sum(F.when(F.col("gram").isNotNull(), F.coalesce("ratio", F.lit(NEUTRAL)))).alias("sum"),
    )
    mean = F.coalesce(F.try_divide(F.col("sum"), F.col("size")) / PARTS, F.lit(0.0))
    if model is None:
        return found.withColumn("score", mean)
    held = model.held.withColumnRenamed("score", "held")
    return found.join(held, "digest", "left").withColumn("score", F.coalesce("held", mean)).drop("held")


def judge_quality(docs: DataFrame, model: Model | None, text: str = "text", prefix: str = "") -> DataFrame:
    """Every row of `docs` with its counts, `base_failed`, `score` and `kept`.

    `score` is the mean ratio over the words and word pairs of the whole text, 0 for a
    text without words; a trusted text has its held-out score. `base_failed`: fewer than 50
    words, or more than half of the words in repeated windows of three. `kept`: not
    `base_failed` and a score of at least the model's threshold. Without a model all scores
    are 0 and the base rules alone decide.

    Texts are judged once each; what is found is joined to the rows by a digest, broadcast
    if it is small enough. The names of the results begin with `prefix`; columns of `docs`
    with the same names are replaced, all others are carried on, whatever their names. NULL
    and empty texts have no words and fail. Repeated rows stay, equal texts fare alike. Long
    texts are judged whole. An empty table gives an empty table.
    """
    p = free_prefix(docs)
    found = _written(_judged_texts(docs, model, text), "quality-texts")
    small = fits_broadcast(measure(found))
    found = found.select(*(F.col(c).alias(p + c) for c in found.columns))
    found = F.broadcast(found) if small else found
    step = docs.join(found, text_key(docs[text]) == F.col(f"{p}digest"))
    n, repeats, score = F.col(f"{p}_n_words"), F.col(f"{p}_n_repeat_words"), F.col(f"{p}score")
    failed = (n < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n)
    threshold = -math.inf if model is None else model.threshold
    new = [prefix + name for name in (*COUNTS, "base_failed", "score", "kept")]
    return step.select(
        *(docs[c] for c in docs.columns if c.lower() not in {name.lower() for name in new}),
        *(F.col(f"{p}_{name}").alias(prefix + name) for name in COUNTS),
        failed.alias(f"{prefix}base_failed"),
        score.alias(f"{prefix}score"),
        (~failed & (score >= threshold)).alias(f"{prefix}kept"),
    )
