"""Table operators: labels, reports, rule matching, page chains, line numbering and landing."""

from .chains import chain_gaps, page_chains, page_links
from .landing import file_summary, land_chunks, land_lines, roll_files
from .numbering import number_lines, number_text
from .report import console_form, label_counts, label_report, share_report
from .rules import match_rules
from .sentiment import Lookup, label_posts, label_tokens, prepare_lexicon

__all__ = [
    "Lookup",
    "chain_gaps",
    "console_form",
    "file_summary",
    "label_counts",
    "label_posts",
    "label_report",
    "label_tokens",
    "land_chunks",
    "land_lines",
    "match_rules",
    "number_lines",
    "number_text",
    "page_chains",
    "page_links",
    "prepare_lexicon",
    "roll_files",
    "share_report",
]
