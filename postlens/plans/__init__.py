"""Whole jobs, from files to a report or a table."""

from .jobs import (
    account_report,
    compact_lake,
    follow_lake,
    labels_report,
    lake_report,
    land_files,
    land_live,
    page_gaps,
    running_report,
    score_lake,
    tokenize_checked,
    tokenize_lake,
)

__all__ = [
    "account_report",
    "compact_lake",
    "follow_lake",
    "labels_report",
    "lake_report",
    "land_files",
    "land_live",
    "page_gaps",
    "running_report",
    "score_lake",
    "tokenize_checked",
    "tokenize_lake",
]
