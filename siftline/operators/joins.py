"""Look-up joins whose small side is counted before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most rows that a side is broadcast with; beyond it the join shuffles, and AQE splits its hot keys.
BROADCAST_ROWS = 100_000


def counted(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """side, marked for broadcast if it has at most so many rows; no more than that many are read to find out."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def look_up(df: DataFrame, side: DataFrame, on: str | list[str] | Column, how: str = "left") -> DataFrame:
    return df.join(counted(side), on, how)
