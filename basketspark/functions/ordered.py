"""Running aggregates over ordered groups of any size.

A window sorts a whole group inside one task. Groups that are too large for that are cut into
blocks with a range partitioning on (group, order): rows are aggregated inside their block, the
block totals are scanned (at most one row per partition and group) and carried into the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import stable

BLOCK = "_blk"
MAX_GROUP_ROWS = 1_000_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    # least / greatest skip nulls
    return F.least(carry, local) if kind == "min" else F.greatest(carry, local)


def with_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition ``df`` and fix each row's block number.

    The checkpoint pins the sampled range bounds, so every later branch sees the same blocks.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, *order]])
    return stable(ranged.withColumn(BLOCK, F.spark_partition_id()))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates ``{out: (kind, column)}`` in ``order``; ``order`` must be unique per group.

    ``exclusive`` leaves the current row out (null, or 0 for sums, on the first row).
    """
    last = -1 if exclusive else 0
    blocked = BLOCK in df.columns
    part = [*by, BLOCK] if blocked else list(by)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    out = df.select("*", *[_AGG[k](c).over(w).alias(o) for o, (k, c) in aggs.items()])
    if not blocked:
        if exclusive:
            out = out.withColumns(
                {o: F.coalesce(F.col(o), F.lit(0)) for o, (k, _) in aggs.items() if k == "sum"}
            )
        return out
    totals = df.groupBy(*part).agg(*[_AGG[k](c).alias(f"_t_{o}") for o, (k, c) in aggs.items()])
    wt = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[_AGG[k](f"_t_{o}").over(wt).alias(f"_c_{o}") for o, (k, _) in aggs.items()])
    joined = out.join(carry, part)
    return joined.select(
        *df.columns, *[_merge(k, F.col(f"_c_{o}"), F.col(o)).alias(o) for o, (k, _) in aggs.items()]
    )


def by_group_size(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    step: Callable[[DataFrame], DataFrame],
    max_group_rows: int | None = None,
) -> DataFrame:
    """Run ``step`` (built on :func:`scan`) with plain windows, and with blocks for oversized groups."""
    limit = max_group_rows or MAX_GROUP_ROWS
    heavy = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*by)
    if heavy.isEmpty():
        return step(df)
    heavy = stable(heavy)
    light_out = step(df.join(heavy, list(by), "left_anti"))
    heavy_out = step(with_blocks(df.join(heavy, list(by), "left_semi"), by, order)).drop(BLOCK)
    return light_out.unionByName(heavy_out)


def prepared(df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """``df`` written out, cut into blocks only if it is too long for one task per group."""
    settled = stable(df)
    if settled.count() <= (max_rows or MAX_GROUP_ROWS):
        return settled
    return with_blocks(settled, by, order)


def number_rows(df: DataFrame, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Zero-based position in ``order`` (unique), overall or within a few large groups."""
    b = prepared(df.withColumn("_one", F.lit(1).cast("long")), by, order)
    return scan(b, by, order, {out: ("sum", "_one")}, exclusive=True).drop("_one", BLOCK)
