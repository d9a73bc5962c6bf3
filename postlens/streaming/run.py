"""Waiting for a query that ends by itself."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery


def run_available(query: StreamingQuery, timeout: int) -> None:
    """Wait for an `available_now` query; fail rather than leave half of its input."""
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream did not finish in {timeout} seconds")
    finally:
        query.stop()
