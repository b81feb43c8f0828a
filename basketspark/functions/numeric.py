"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(x: Column | str, digits: int) -> Column:
    """Half-up rounding on doubles that every engine evaluates to the same bits."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / F.lit(scale)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour periods between two timestamps, the later one first."""
    return F.extract(F.lit("DAY"), later - earlier).cast("long")


def entropy(df: DataFrame, keys: Sequence[str], weight: str, out: str) -> DataFrame:
    """Base-2 Shannon entropy of the ``weight`` shares within each key, two decimals.

    Uses log2(M) - sum(m*log2 m)/M, so one partially aggregated pass suffices.
    """
    m = F.col(weight).cast("double")
    total = F.sum(m)
    raw = F.log2(total) - F.sum(m * F.log2(m)) / total
    # a single share can leave a tiny negative residue
    return df.groupBy(*keys).agg((rnd(F.greatest(raw, F.lit(0.0)), 2) + F.lit(0.0)).alias(out))


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column (scalar subquery, evaluated once)."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).scalar()
