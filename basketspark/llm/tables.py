"""Small pieces shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """Count once whether ``df`` has at most ``rows`` rows; a function that marks tables of its length for broadcast."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda side: side


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if it is counted to have at most ``rows`` rows; else join it plainly."""
    return small_side(df, rows)(df)


def broadcast_within(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast if it is counted to have at most ``rows`` rows and ``size`` bytes; else join it plainly.

    Strings count by their length, arrays by their text, and other values as eight bytes.
    """
    wide = [c for c, t in df.dtypes if t == "string" or t.startswith(("array", "struct", "map", "binary"))]
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= size else df
