"""Counts and shares per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = ("label", "share")


def label_counts(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def share_report(counts: DataFrame, order: str = "label") -> DataFrame:
    """`label`, `n` and the percentage of all, by label or by falling share.

    The window over everything runs after the counting, on one row per label.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    total = F.sum("n").over(Window.partitionBy())
    report = counts.select("label", "n", F.round(F.col("n") / total * 100, 2).alias("pct"))
    if order == "label":
        return report.orderBy("label")
    return report.orderBy(F.desc("pct"), "label")


def label_report(labels: DataFrame, order: str = "label", label: str = "label") -> DataFrame:
    return share_report(label_counts(labels, label), order)


def console_form(report: DataFrame) -> DataFrame:
    """The report under its printed headings, for ``show(truncate=False)``."""
    # The printed headings.
    return report.select("label", "n", "pct").toDF("Sentiment-Analysis", "Sum", "Percentage(%)")
