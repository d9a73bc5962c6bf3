"""URL rules by host and path, found by hashed expressions.

Every URL is expanded into expressions, one for each (host suffix, path prefix) pair of
a shape that some rule has. Expressions meet rules in an equi-join on the first four
bytes of their SHA-256; the whole digest and both lengths then confirm the match, and
the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import free_name
from postlens.sizing import fits_broadcast, measure

PREFIX_HEX = 8  # four bytes

# Parts of an expression's rows where the rules are too many for a broadcast.
SALTS = 32

AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 2)


def expression_digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules `host, path, verdict`, one per (host, path), with digest and precedence.

    Hosts are lower-cased like those of URLs. A NULL path means any path. Rules without
    host or verdict are left out; of equal rules with different verdicts, block wins.
    """
    host = F.translate(F.col("host"), UPPER, LOWER).alias("rule_host")
    path = F.coalesce(F.col("path"), F.lit("")).alias("rule_path")
    known = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(host, path, "verdict")
    return (
        known.groupBy("rule_host", "rule_path")
        .agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
        .withColumn("digest", expression_digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Every row of `pages` with `host`, `path`, `rule` and `verdict` added.

    A rule fits its host and all subdomains if the URL's path starts with the rule's
    path. Of several, the longest (host and path together, then host) wins. Without
    one, `rule` is NULL and `verdict` is `default`. NULL URLs and those without `://`
    have an empty host and path and fit no rule. Rows are never merged: repeated rows
    and NULL keys come out as often as they went in. No rules at all: all `default`.

    Columns of `pages` named like the new ones are replaced.
    """
    row, expression = free_name(pages, "url_row"), free_name(pages, "url_expression")
    rules = prepare_rules(rules)
    shape = rules.agg(
        F.collect_set("labels").alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    judged = (
        pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url))
        .withColumn(row, F.monotonically_increasing_id())
        .withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    )
    own = [c for c in judged.columns if c not in (row, "host", "path")]
    found = judged.select(row, "host", "path").where("host != ''")
    found = _expanded(found, row, expression, shape["labels"], shape["lengths"])
    matched = _meet(found, rules, expression, row)
    best = matched.groupBy(row).agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("length"),
                F.length("rule_host").alias("host_length"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "verdict",
            )
        ).alias("best")
    )
    return judged.join(best, row, "left").select(
        *own,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _expanded(urls: DataFrame, row: str, name: str, labels: list[int], lengths: list[int]):
    """One row per expression of a URL: digest, its prefix and the lengths behind it."""
    parts = F.split("host", r"\.")
    suffixes = F.filter(F.lit(sorted(labels) or [0]).cast("array<int>"), lambda n: n <= F.size(parts))
    prefixes = F.filter(
        F.lit(sorted(lengths) or [0]).cast("array<int>"), lambda n: n <= F.length("path")
    )
    # Two generators in a row, so that the pairs never form one array.
    return (
        urls.withColumn("_n", F.explode(suffixes))
        .withColumn("_m", F.explode(prefixes))
        .select(
            row,
            F.array_join(F.slice(parts, F.size(parts) - F.col("_n") + 1, F.col("_n")), ".").alias("_h"),
            F.substr("path", F.lit(1), F.col("_m")).alias("_p"),
        )
        .where("_h != ''")
        .select(row, expression_digest(F.col("_h"), F.col("_p")).alias(name))
    )


def _meet(found: DataFrame, rules: DataFrame, expression: str, row: str) -> DataFrame:
    """Equi-join on digest prefixes, confirmed by whole digests.

    Rules are broadcast only if their measured size allows; else both sides shuffle, and
    every prefix is split into parts by row, since one host may hold a third of the rows.
    """
    left = found.withColumn("prefix", F.substring(expression, 1, PREFIX_HEX))
    right = rules.select("prefix", "digest", "rule_host", "rule_path", "verdict")
    if fits_broadcast(measure(right)):
        joined = left.join(F.broadcast(right), "prefix")
    else:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = left.join(right.withColumn("_salt", parts).hint("merge"), ["prefix", "_salt"])
    return joined.where(F.col(expression) == F.col("digest"))
