"""Polarity labels for posts.

A post of two or more tokens scores +1 for every positive token and -1 for every
negative one, and is positive, negative or (at zero) mixed. A post of one token
gets that token's own polarity, or mixed.

Two edge modes:

``clean``
    Empty tokens are dropped.
``as_reference``
    The first and the last token are never looked up, empty tokens count as
    tokens, and posts of fewer than two tokens are mixed.

Three plans give the same labels; `prepare_lexicon` picks by measured size:

``row``
    The words become constant sets in the expression. No shuffle.
``broadcast``
    Tokens are exploded and joined with a broadcast lexicon; one shuffle on a
    number given to each row, after its tokens were added up where they were read.
``salted``
    As before with a shuffle join. Tokens that a Bloom filter of the lexicon turns away are
    not shuffled, and words found to be hot are split into parts by their share.

Under both join plans columns other than numbers are not carried along with the tokens: the
posts are written once with the numbers of their rows, and what was added up is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokenize, without_empty
from ..lookup import Bloom, bloom
from ..sizing import Size, fits_broadcast, measure, salted_join
from ..workspace import new_folder

# Up to here the lexicon travels inside the plan; published lexicons have 5,000 to 15,000 words.
ROW_WORDS = 20_000
WORD_BYTES = 256

# The tokens are filtered before their shuffle if no more than this share of them passes, by
# the tokens of one post in so many.
WORTH = 0.5
JUDGED = 16

EDGES = ("clean", "as_reference")
STRATEGIES = ("auto", "row", "broadcast", "salted")


class Lookup(NamedTuple):
    """A lexicon made ready for scoring."""

    strategy: str
    table: DataFrame
    words: dict[str, list[str]]
    known: Bloom | None = None
    size: Size | None = None


def prepare_lexicon(
    lexicon: DataFrame | Lookup,
    strategy: str = "auto",
    row_words: int = ROW_WORDS,
) -> Lookup:
    """Drop the entries that count as not found and choose a plan by what is left.

    `lexicon` has one row per word, as `first_polarity` gives it.

    The words reach the driver only once they are known to be few. A named strategy
    is taken only where the lexicon fits it. Whatever the plan, the lexicon is read once,
    here: a larger one is written to the shared folder, and that table is measured and
    joined, so later changes of its files do not reach a prepared lexicon.
    """
    if isinstance(lexicon, Lookup):
        return lexicon
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    table = lexicon.filter(
        F.col("word").isNotNull() & F.col("polarity").isNotNull() & (F.col("polarity") != "")
    ).select("word", "polarity")
    folder = new_folder(table.sparkSession, "lexicon")
    # What is looked at first is kept until it is written, so that it is not worked out twice.
    read = table.persist() if strategy in ("auto", "row") else table
    try:
        words = _few_words(read, row_words) if strategy in ("auto", "row") else None
        if words is not None:
            return Lookup("row", table, words)
        read.write.parquet(folder)
    finally:
        if strategy in ("auto", "row"):
            read.unpersist()
    table = table.sparkSession.read.schema(table.schema).parquet(folder)
    size = measure(table)
    if strategy in ("auto", "broadcast") and fits_broadcast(size):
        return Lookup("broadcast", table, {})
    if strategy in ("row", "broadcast"):
        raise ValueError(f"a lexicon of {size} is too large for the {strategy} strategy")
    return Lookup("salted", table, {}, bloom(table, "word", size.rows), size)


def _few_words(table: DataFrame, most: int) -> dict[str, list[str]] | None:
    """Words by polarity, or None when there are more than `most` or any is very long.

    What reaches the driver is bounded in rows and in bytes: a long value comes as NULL.
    """
    short = [F.when(F.octet_length(c) <= WORD_BYTES, F.col(c)).alias(c) for c in table.columns]
    head = table.select(*short).limit(most + 1).collect()
    if len(head) > most or any(row.word is None or row.polarity is None for row in head):
        return None
    words: dict[str, list[str]] = {}
    for row in head:
        words.setdefault(row.polarity, []).append(row.word)
    return words


def label_posts(
    posts: DataFrame,
    lexicon: DataFrame | Lookup,
    tokenizer: str = "ws",
    edges: str = "clean",
    text: str = "text",
    key: str | Sequence[str] = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """`key`, the columns `keep`, `score` and `label` for every post, from its text."""
    keys = [*([key] if isinstance(key, str) else key), *keep]
    tokens = posts.select(*keys, tokenize(F.col(text), tokenizer).alias("_tokens"))
    return label_tokens(tokens, lexicon, edges=edges, tokens="_tokens", key=keys)


def label_tokens(
    posts: DataFrame,
    lexicon: DataFrame | Lookup,
    edges: str = "clean",
    tokens: str = "text",
    key: str | Sequence[str] = "id",
) -> DataFrame:
    """`key`, `score` and `label` for every post, from its token array.

    Every row is a post of its own: keys may repeat or be NULL.
    """
    if edges not in EDGES:
        raise ValueError(f"edges must be one of {EDGES}, not {edges!r}")
    lookup = prepare_lexicon(lexicon)
    keys = [key] if isinstance(key, str) else list(key)
    dropped = without_empty(F.col(tokens)) if edges == "clean" else F.col(tokens)
    cut = posts.select(*keys, dropped.alias("_tokens"))
    score = _score_in_row if lookup.strategy == "row" else _score_by_join
    return score(cut, lookup, keys, edges).select(*keys, "score", _label(edges).alias("label"))


# The tokens that are looked up, by edge mode.
_SCORED = {
    "clean": "_tokens",
    "as_reference": (
        "CASE WHEN array_size(_tokens) > 1 THEN slice(_tokens, 2, array_size(_tokens) - 2) END"
    ),
}


def _label(edges: str) -> Column:
    label = (
        F.when((F.col("_n") > 1) & (F.col("score") > 0), "positive")
        .when((F.col("_n") > 1) & (F.col("score") < 0), "negative")
    )
    if edges == "clean":
        label = label.when(F.col("_n") == 1, F.coalesce("_polarity", F.lit("mixed")))
    return label.otherwise("mixed")


def _score_in_row(cut: DataFrame, lookup: Lookup, keys: list[str], edges: str) -> DataFrame:
    """`_n`, `score` and `_polarity` per post, by sets of constants."""
    sets = {polarity: _constants(words) for polarity, words in lookup.words.items()}
    # Most tokens are in neither set, so one lookup in their union settles them.
    signed = [sets[polarity] for polarity in ("positive", "negative") if polarity in sets]
    hit = f"token IN ({', '.join(signed)})" if signed else "false"
    up = f"token IN ({sets['positive']})" if "positive" in sets else "false"
    own = " ".join(
        f"WHEN get(_tokens, 0) IN ({words}) THEN {_constants([polarity])}"
        for polarity, words in sets.items()
    )
    polarity = f"CASE WHEN array_size(_tokens) = 1 THEN CASE {own} END END" if own else "NULL"
    hits = cut.select(
        *keys,
        F.array_size("_tokens").alias("_n"),
        F.expr(f"filter({_SCORED[edges]}, token -> {hit})").alias("_hits"),
        F.expr(f"CAST({polarity} AS STRING)").alias("_polarity"),
    )
    difference = f"2L * array_size(filter(_hits, token -> {up})) - array_size(_hits)"
    return hits.select(
        *keys, "_n", F.expr(f"coalesce({difference}, 0L)").alias("score"), "_polarity"
    )


def _constants(words: Sequence[str]) -> str:
    """Words as a comma-separated list of SQL constants.

    Words with a quote or a backslash are given as bytes, whose meaning does not
    depend on how the session reads escapes; so are those with a dollar sign, which
    could name a variable that SQL text would have replaced.
    """
    return ", ".join(
        f"CAST(X'{word.encode().hex()}' AS STRING)" if any(mark in word for mark in "'\\$") else f"'{word}'"
        for word in words
    )


# Types that may be part of a group key of numbers.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")


def _score_by_join(cut: DataFrame, lookup: Lookup, keys: list[str], edges: str) -> DataFrame:
    """The same by a join of single tokens with the lexicon.

    A number given to each row before its tokens part tells posts with equal keys apart.
    Numbers among the other columns go along with it. If there are others, or more than one
    pass over the posts is needed, the posts are first written with their numbers, and only
    those of posts with hits come back to be joined with what is kept.
    """
    posts = cut.withColumn("_row", F.monotonically_increasing_id())
    narrow = all(kind in _NUMBERS for name, kind in cut.dtypes if name in keys)
    if lookup.strategy == "broadcast" and narrow:
        words = posts.select(
            "_row", *keys, F.array_size("_tokens").alias("_n"), F.explode_outer(F.expr(_SCORED[edges])).alias("word")
        )
        found = words.join(F.broadcast(lookup.table), "word", "left")
        return _added_up(found, ["_row", *keys, "_n"])
    folder = new_folder(posts.sparkSession, "posts")
    posts.withColumn("_n", F.array_size("_tokens")).write.parquet(folder)
    posts = posts.sparkSession.read.parquet(folder)
    words = posts.select("_row", "_n", F.explode(F.expr(_SCORED[edges])).alias("word"))
    if lookup.strategy == "broadcast":
        found = words.join(F.broadcast(lookup.table), "word")
    else:
        if lookup.known is not None and _filter_helps(words, lookup.known):
            words = words.where(lookup.known.passes(F.col("word")))
        size = lookup.size.bytes if lookup.size else None
        found = salted_join(words, lookup.table, "word", "inner", [F.col("_row")], dim_bytes=size)
    scores = _added_up(found, ["_row", "_n"]).drop("_n")
    kept = posts.select("_row", *keys, "_n").join(scores, "_row", "left")
    return kept.select(*keys, "_n", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"), "_polarity")


def _filter_helps(words: DataFrame, known: Bloom) -> bool:
    """Whether few enough tokens pass; a filter that most pass costs more than it saves.

    Judged by the tokens of some posts, since it changes the plan only, not what is joined.
    """
    some = words.where(F.pmod(F.xxhash64("_row"), F.lit(JUDGED)) == 0)
    row = some.agg(F.count(F.lit(1)).alias("n"), F.count_if(known.passes(F.col("word"))).alias("passed")).first()
    return row["passed"] <= row["n"] * WORTH


def _added_up(found: DataFrame, group: list[str]) -> DataFrame:
    """`score` and `_polarity` of every post, from its tokens and their polarities."""
    points = (
        F.when(F.col("polarity") == "positive", 1)
        .when(F.col("polarity") == "negative", -1)
        .otherwise(0)
    )
    # Of a post of one token there is one row, so its polarity can be part of the
    # group, which leaves a sum of numbers as the only thing to aggregate.
    own = F.when(F.col("_n") == 1, F.col("polarity")).alias("_polarity")
    return found.groupBy(*group, own).agg(F.sum(points).alias("score"))
