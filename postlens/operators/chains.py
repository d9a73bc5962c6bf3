"""Chains of search pages: each page names the token of the next one.

A page is found by its account and the token it was asked for with, which is NULL for an
account's first page. Pointers to the next page are doubled by self-joins: those over 2^k
pages, joined with themselves, lead over 2^(k+1), so chains of n pages take log2(n) joins
of narrow rows, and no chain is followed page by page or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import new_folder


def _written(rows: DataFrame) -> DataFrame:
    folder = new_folder(rows.sparkSession, "chains")
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def page_links(pages: DataFrame) -> DataFrame:
    """`account, token, next_token, n_copies` for every stored page of `CHAINED_PAGE`.

    Pages stored several times are one page, whose next is the least that any copy names.
    """
    rows = pages.select("account", "token", F.col("meta.next_token").alias("next_token"))
    return rows.groupBy("account", "token").agg(
        F.min("next_token").alias("next_token"), F.count(F.lit(1)).alias("n_copies")
    )


def page_chains(links: DataFrame) -> DataFrame:
    """One row per chain: `account, first_token, n_pages, missing, ring`.

    `links` has one row per page: `account`, `token`, `next_token`. A chain begins with a page
    that no stored page names; one whose `first_token` is not NULL has lost the pages before
    it. `missing` is the token of the page after the last one if that is not stored; it is
    NULL if the last page names none.

    Pages that name each other in a ring make a row with `ring` and their least token, and a
    chain that runs into a ring has `ring` and no `n_pages`. A NULL account is an account
    like any other. Without pages there are no rows.
    """
    pages = _written(links.select("account", "token", "next_token"))
    state = _written(_with_targets(pages))
    first = state
    bound = pages.count().bit_length()
    for _ in range(bound):
        if state.where("target IS NOT NULL").isEmpty():
            break
        state = _written(_doubled(state))
    named = first.where("target IS NOT NULL").select(
        F.col("account").alias("_account"), F.col("target").alias("_token")
    )
    heads = state.join(named, _same("account", "_account") & (F.col("token") == F.col("_token")), "left_anti")
    running = F.col("target").isNotNull()
    chains = heads.select(
        "account",
        F.col("token").alias("first_token"),
        F.when(~running, F.col("n_pages")).alias("n_pages"),
        "missing",
        running.alias("ring"),
    )
    return chains.union(_rings(state))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _with_targets(pages: DataFrame) -> DataFrame:
    """Each page with the next stored one as `target`, or the token that is `missing`."""
    known = pages.select(F.col("account").alias("_account"), F.col("token").alias("_token"))
    on = _same("account", "_account") & (F.col("next_token") == F.col("_token"))
    lost = F.when(F.col("_token").isNull(), F.col("next_token"))
    return pages.join(known, on, "left").select(
        "account",
        "token",
        F.col("_token").alias("target"),
        F.lit(1).cast("bigint").alias("n_pages"),
        lost.alias("missing"),
        F.col("token").alias("least"),
    )


def _doubled(state: DataFrame) -> DataFrame:
    """Targets twice as far; what lies between is added up."""
    further = state.toDF(*(f"_{c}" for c in state.columns))
    on = _same("account", "_account") & (F.col("target") == F.col("_token"))
    moved = state.where("target IS NOT NULL").join(further, on).select(
        "account",
        "token",
        F.col("_target").alias("target"),
        (F.col("n_pages") + F.col("_n_pages")).alias("n_pages"),
        F.col("_missing").alias("missing"),
        F.least("least", "_least").alias("least"),
    )
    return moved.union(state.where("target IS NULL"))


def _rings(state: DataFrame) -> DataFrame:
    """The rings among rows whose targets never ended; all their targets lie on rings."""
    on_ring = state.where("target IS NOT NULL").select(
        F.col("account").alias("_account"), F.col("target").alias("_token")
    )
    pages = state.join(on_ring, _same("account", "_account") & (F.col("token") == F.col("_token")), "left_semi")
    return pages.groupBy("account", F.col("least").alias("first_token")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.first("missing").alias("missing"),
        F.lit(True).alias("ring"),
    )


def chain_gaps(chains: DataFrame) -> DataFrame:
    """One row per account: `account, n_pages, n_chains, n_gaps, first_gap, complete`.

    `n_gaps` counts the named pages that are not stored, and one more if the first page is
    not. `first_gap` is the least missing token. An account is complete if its pages make
    one chain from its first page to one that names no next.
    """
    start = F.count(F.when(F.col("first_token").isNull(), True))
    gaps = F.count("missing") + F.when(start == 0, 1).otherwise(0)
    return chains.groupBy("account").agg(
        F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"),
        F.count(F.lit(1)).alias("n_chains"),
        gaps.alias("n_gaps"),
        F.min("missing").alias("first_gap"),
        ((F.count(F.lit(1)) == 1) & (gaps == 0) & ~F.max("ring")).alias("complete"),
    )
