"""Readers: paged responses, JSON lines, lexicon files, token tables, rule responses."""

from .drift import field_kinds, merged_schema, schema_drift
from .lexicon import (
    first_polarity,
    parse_keyed,
    parse_positional,
    read_keyed_lines,
    read_lexicon,
    read_positional_fields,
    word_polarity,
)
from .lines import bounded, infer_schema, read_lines, sample_file, stream_lines, token_rows
from .pages import has_next, page_counts, page_posts, parse_pages, read_pages, union_posts
from .rules import parse_rule_responses, read_rules, rule_ids, rules_table, store_rules
from .tables import read_tokens

__all__ = [
    "bounded",
    "field_kinds",
    "first_polarity",
    "has_next",
    "infer_schema",
    "merged_schema",
    "page_counts",
    "page_posts",
    "parse_keyed",
    "parse_pages",
    "parse_positional",
    "parse_rule_responses",
    "read_keyed_lines",
    "read_lexicon",
    "read_lines",
    "read_pages",
    "read_positional_fields",
    "read_rules",
    "read_tokens",
    "rule_ids",
    "rules_table",
    "sample_file",
    "schema_drift",
    "store_rules",
    "stream_lines",
    "token_rows",
    "union_posts",
    "word_polarity",
]
