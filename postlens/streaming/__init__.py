"""Streams: text lines to landing files, lines to token tables, tokens to labels and reports."""

from .checked import (
    add_rules,
    read_batch_counts,
    read_checked_tokens,
    read_rejected,
    rules_version,
    start_checked_tokens,
)
from .labels import read_labels, start_labels
from .landing import start_landing
from .report import read_report, start_report
from .run import run_available
from .tokens import session_with, start_tokens, stream_tokens

__all__ = [
    "add_rules",
    "read_batch_counts",
    "read_checked_tokens",
    "read_labels",
    "read_rejected",
    "read_report",
    "rules_version",
    "run_available",
    "session_with",
    "start_checked_tokens",
    "start_labels",
    "start_landing",
    "start_report",
    "start_tokens",
    "stream_tokens",
]
