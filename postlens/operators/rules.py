"""Posts of ruled accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sizing import fits_broadcast, measure, salted_join

PREFIX = "from:"

# Up to here the accounts are also given to the scan as a filter.
FILTER_RULES = 1_000
FILTER_BYTES = 64 * 1024


def match_rules(
    posts: DataFrame, rules: DataFrame, account: str = "account", tags: bool = True
) -> DataFrame:
    """Posts whose account a rule ``from:<account>`` names.

    With `tags` there is one row per matched rule, with its tag; without, every
    matching post once.
    """
    how = "inner" if tags else "left_semi"
    named = rules.filter(F.startswith("value", F.lit(PREFIX))).select(
        F.substring("value", F.lit(len(PREFIX) + 1), F.length("value")).alias(account),
        *(["tag"] if tags else []),
    )
    size = measure(named)
    if size.rows <= FILTER_RULES and size.bytes <= FILTER_BYTES:
        accounts = [row[account] for row in named.select(account).distinct().collect()]
        posts = posts.filter(F.col(account).isin(accounts))
        if not tags:
            return posts
    if fits_broadcast(size):
        matched = posts.join(F.broadcast(named), account, how)
    else:
        # Rows are spread by their place in their split, which a task that runs again finds
        # again, so columns of any type may stand beside the account.
        row = "_row"
        while row in posts.columns:
            row = f"_{row}"
        posts_by_row = posts.withColumn(row, F.monotonically_increasing_id())
        matched = salted_join(posts_by_row, named, account, how, [F.col(row)])
    return matched.select(*posts.columns, *(["tag"] if tags else []))
