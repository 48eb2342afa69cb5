"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a list (samples, chromosomes) that is sent to all executors; a longer one is joined like any table.
MOST = 100_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
