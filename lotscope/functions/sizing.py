"""Broadcast hints that are only given once the size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, without counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint ``df`` for broadcast when it is proven small.  Otherwise it is left as it
    is: Spark then joins by shuffle, and splits hot keys at run time."""
    return F.broadcast(df) if at_most(df, rows) else df
