"""Sentiment shares of an account's posts, from stored pages and from streams."""

from . import functions, operators, plans, schemas, sources, streaming

__all__ = ["functions", "operators", "plans", "schemas", "sources", "streaming"]
