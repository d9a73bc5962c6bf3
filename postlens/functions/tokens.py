"""Text to token arrays and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens_ws(text: Column) -> Column:
    """Split on every single space. Punctuation stays on the word, empty tokens are kept."""
    return F.split(text, " ")


def tokens_nw(text: Column) -> Column:
    r"""Split on runs of characters outside ``[A-Za-z0-9_]``. Edge empties are kept."""
    return F.split(text, r"\W+")


def tokens_to_text(tokens: Column) -> Column:
    """``[a, b, c]``: the text form of a token array."""
    return tokens.cast("string")


def tokens_from_text(text: Column) -> Column:
    """Split on comma and space, the separator of `tokens_to_text`."""
    return F.split(text, ", ")


def without_empty(tokens: Column) -> Column:
    return F.array_remove(tokens, "")


_TOKENIZERS = {"ws": tokens_ws, "nw": tokens_nw}


def tokenize(text: Column, tokenizer: str) -> Column:
    if tokenizer not in _TOKENIZERS:
        raise ValueError(f"tokenizer must be one of {sorted(_TOKENIZERS)}, not {tokenizer!r}")
    return _TOKENIZERS[tokenizer](text)
