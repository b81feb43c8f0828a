"""Exact, linearly interpolated quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan, with_blocks

SMALL_DISTINCT = 500_000


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """One row per group with a double column per quantile.

    Equal values are counted before anything is ordered. A short list of counts is accumulated by a
    window, a long one over range-partitioned blocks; the two ranks around each quantile are picked out.
    """
    names = list(names or [f"p{round(q * 100):02d}" for q in qs])
    by = list(by)
    x = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null")
    counts = x.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_m"))
    distinct = x.agg(F.approx_count_distinct(F.struct(*[F.col(c) for c in x.columns]))).first()[0]
    if distinct <= SMALL_DISTINCT:
        cum = scan(counts, by, ["_x"], {"_end": ("sum", "_m")})
        cum = cum.withColumn("_n", F.sum("_m").over(Window.partitionBy(*by)))
    else:
        blocks = with_blocks(counts, by, ["_x"])
        sizes = blocks.groupBy(*by).agg(F.sum("_m").alias("_n"))
        cum = scan(blocks, by, ["_x"], {"_end": ("sum", "_m")})
        cum = cum.join(sizes, by) if by else cum.withColumn("_n", sizes.scalar())
    picks, values = [], []
    for i, (q, name) in enumerate(zip(qs, names)):
        pos = f"{float(q)!r}D * (_n - 1)"
        for rank, tag in ((f"floor({pos})", "lo"), (f"ceil({pos})", "hi")):
            picks.append(f"max(CASE WHEN _end > {rank} AND _end - _m <= {rank} THEN _x END) AS _{tag}{i}")
        picks.append(f"max({pos} - floor({pos})) AS _f{i}")
        values.append(f"_lo{i} + (_hi{i} - _lo{i}) * _f{i} AS `{name}`")
    return cum.groupBy(*by).agg(*[F.expr(e) for e in picks]).selectExpr(*[f"`{c}`" for c in by], *values)
