"""The jobs, as functions of a session and paths.

Reports are returned as DataFrames; nothing is computed before the caller acts on
them, apart from the size check of the lexicon.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import (
    chain_gaps,
    label_posts,
    label_report,
    label_tokens,
    land_lines,
    match_rules,
    number_text,
    page_chains,
    page_links,
    roll_files,
)
from ..operators.landing import LINES_PER_FILE
from ..schemas import ACCOUNT_PAGE, CHAINED_PAGE, PAGE
from ..sources import (
    bounded,
    page_posts,
    read_lexicon,
    read_pages,
    read_rules,
    read_tokens,
    stream_lines,
    token_rows,
)
from ..streaming import (
    read_labels,
    read_report,
    session_with,
    start_checked_tokens,
    start_labels,
    start_landing,
    start_report,
    start_tokens,
    stream_tokens,
)


# Accounts that a message about missing pages names.
NAMED_GAPS = 5

# What a compacting micro-batch takes at most, the files it makes of it, and the input of one file.
COMPACT_BYTES = 2 * 1024 * 1024 * 1024
COMPACT_FILES = 16
COMPACT_FILE_BYTES = 256 * 1024 * 1024

# Input files of a micro-batch, so that a backlog is not one batch that is repeated whole.
MAX_FILES = 1_000


def account_report(
    spark: SparkSession,
    pages: str,
    lexicon: str,
    edges: str = "clean",
    multi_line: bool = False,
    rules: str | None = None,
    gaps: str | None = None,
) -> DataFrame:
    """Stored search pages to a share report, ordered by label.

    With `rules`, a folder of stored rules, only posts whose account one of them names
    count; the pages then carry an account with each post.

    With `gaps` the pages carry what they were asked for with (`CHAINED_PAGE`), and their
    chains are followed first: accounts of which a page is missing are a warning if it is
    "warn", an error if it is "fail".
    """
    if gaps not in (None, "warn", "fail"):
        raise ValueError(f"gaps must be 'warn' or 'fail', not {gaps!r}")
    if gaps is not None:
        _report_gaps(page_gaps(spark, pages, multi_line), gaps == "fail")
    schema = PAGE if rules is None else ACCOUNT_PAGE
    posts = page_posts(read_pages(spark, pages, schema, multi_line))
    if rules is not None:
        posts = match_rules(posts, read_rules(spark, rules), tags=False)
    words = read_lexicon(spark, lexicon, "keyed")
    return label_report(label_posts(posts, words, "ws", edges), "label")


def page_gaps(spark: SparkSession, pages: str, multi_line: bool = False) -> DataFrame:
    """How complete the stored pages of every account are."""
    stored = read_pages(spark, pages, CHAINED_PAGE, multi_line)
    return chain_gaps(page_chains(page_links(stored)))


def _report_gaps(accounts: DataFrame, fail: bool) -> None:
    """Name some of the accounts that are not complete."""
    cut = accounts.where("NOT complete")
    number = cut.count()
    if not number:
        return
    named = [
        f"{row.account} (after {row.n_pages} pages: {row.first_gap or 'its first page or a single end'})"
        for row in cut.orderBy("account").limit(NAMED_GAPS).collect()
    ]
    message = f"pages are missing for {number} accounts, among them {', '.join(named)}"
    if fail:
        raise ValueError(message)
    warnings.warn(message, stacklevel=3)


def land_files(spark: SparkSession, lines: str, path: str, per_file: int = LINES_PER_FILE) -> None:
    """Text lines to published landing files, numbered in the order of the input files.

    The lines are shuffled once, by the number of their landing file.
    """
    land_lines(roll_files(number_text(spark, lines), per_file), path)


def land_live(
    spark: SparkSession,
    lines: str,
    path: str,
    checkpoint: str,
    per_file: int = LINES_PER_FILE,
    available_now: bool = False,
    max_files: int | None = MAX_FILES,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Text lines to landing files as they arrive, as a running stream."""
    reader = bounded(spark.readStream, max_files, max_bytes)
    return start_landing(reader.text(lines), path, checkpoint, per_file, available_now)


def tokenize_lake(
    spark: SparkSession,
    lines: str,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    max_files: int | None = MAX_FILES,
    max_bytes: int | None = None,
    row_group_bytes: int | None = None,
    keep_corrupt: bool = False,
) -> StreamingQuery:
    """Landed JSON lines to a token table, as a running stream."""
    rows = token_rows(stream_lines(spark, lines, max_files=max_files, max_bytes=max_bytes), keep_corrupt)
    return start_tokens(rows, path, checkpoint, available_now, row_group_bytes)


def compact_lake(
    spark: SparkSession,
    tokens: str,
    path: str,
    checkpoint: str,
    files: int = COMPACT_FILES,
    available_now: bool = True,
    max_bytes: int = COMPACT_BYTES,
    file_bytes: int = COMPACT_FILE_BYTES,
) -> StreamingQuery:
    """A token table of many small files to one of few, batch by batch, by default what is there.

    The new folder is a token table of its own, with the sink's commit log, so tables and
    streams that read it see every row once; run again, it adds what has come since. Each
    micro-batch takes up to `max_bytes` of files that the old table's log names and makes up
    to `files` of them, without a shuffle. Where they would take in more than `file_bytes`
    each, it makes as many more as that needs, so what a task reads does not grow with the
    batch. The old folder is left as it is.
    """
    # The scan packs its files, as many as fit, in a session whose settings stay its own.
    packing = {
        "spark.sql.files.minPartitionNum": files,
        "spark.sql.files.maxPartitionBytes": file_bytes,
        "spark.sql.files.openCostInBytes": 0,
    }
    most = max(files, -(-max_bytes // file_bytes))
    rows = stream_tokens(session_with(spark, packing), tokens, max_bytes=max_bytes).coalesce(most)
    return start_tokens(rows, path, checkpoint, available_now)


def lake_report(
    spark: SparkSession, tokens: str, lexicon: str, edges: str = "clean"
) -> DataFrame:
    """The token table to a share report, largest share first."""
    words = read_lexicon(spark, lexicon, "positional")
    return label_report(label_tokens(read_tokens(spark, tokens), words, edges), "share")


def score_lake(
    spark: SparkSession,
    tokens: str,
    lexicon: str,
    path: str,
    checkpoint: str,
    edges: str = "clean",
    available_now: bool = False,
    max_files: int | None = MAX_FILES,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """The token table to labels, micro-batch by micro-batch, as a running stream."""
    words = read_lexicon(spark, lexicon, "positional")
    return start_labels(
        stream_tokens(spark, tokens, max_files, max_bytes), words, path, checkpoint, edges, available_now
    )


def follow_lake(
    spark: SparkSession,
    tokens: str,
    lexicon: str,
    path: str,
    checkpoint: str,
    edges: str = "clean",
    available_now: bool = False,
    max_files: int | None = MAX_FILES,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """The token table to a share report that is published anew after every micro-batch."""
    words = read_lexicon(spark, lexicon, "positional")
    rows = stream_tokens(spark, tokens, max_files, max_bytes)
    return start_report(rows, words, path, checkpoint, edges, available_now)


def running_report(spark: SparkSession, report: str) -> DataFrame:
    """The report that `follow_lake` has published last, largest share first."""
    return read_report(spark, report)


def tokenize_checked(
    spark: SparkSession,
    lines: str,
    path: str,
    checkpoint: str,
    rules: str | None = None,
    available_now: bool = False,
    max_files: int | None = MAX_FILES,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Landed lines to tokens of ruled accounts, rejected lines and counts, as a running stream."""
    reader = bounded(spark.readStream, max_files, max_bytes)
    return start_checked_tokens(reader.text(lines), path, checkpoint, rules, available_now)


def labels_report(spark: SparkSession, labels: str) -> DataFrame:
    """The labels that `score_lake` has written so far to a share report, largest share first."""
    return label_report(read_labels(spark, labels), "share")
