"""Column functions: tokenizers, text forms of token arrays, one-entry maps, `name=value` fields."""

from .fields import field_value, keyed_field, pair, pair_key, pair_value
from .tokens import (
    tokenize,
    tokens_from_text,
    tokens_nw,
    tokens_to_text,
    tokens_ws,
    without_empty,
)

__all__ = [
    "field_value",
    "keyed_field",
    "pair",
    "pair_key",
    "pair_value",
    "tokenize",
    "tokens_from_text",
    "tokens_nw",
    "tokens_to_text",
    "tokens_ws",
    "without_empty",
]
