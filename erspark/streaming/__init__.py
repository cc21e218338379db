"""The engine's operators are batch; incremental matching is a stream-static
join against a stored reference table (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def match_stream(arrivals: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Key-view pairs of a stream of records with a static reference table."""
    return arrivals.join(reference, keys)
