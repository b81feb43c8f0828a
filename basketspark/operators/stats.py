"""Descriptive statistics and chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_quantiles, one_row, rnd

QUARTILES = [0.25, 0.5, 0.75]
QUARTILE_NAMES = ["q1", "median", "q3"]


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column, value) rows for several numeric columns."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "value")


def describe(
    df: DataFrame,
    cols: Sequence[str],
    where: Column | None = None,
    by: Sequence[str] = (),
    digits: int = 4,
    approximate: bool = False,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column (and group)."""
    base = df if where is None else df.where(where)
    keys = [*by, "column"]
    long = _long(base, cols, by).where("value is not null")
    moments = [
        F.count("value").alias("n"),
        rnd(F.avg("value"), digits).alias("mean"),
        rnd(F.stddev_samp("value"), digits).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if approximate:
        q = F.percentile_approx("value", QUARTILES, 10_000)
        out = long.groupBy(*keys).agg(*moments, q.alias("_q"))
        return out.select(*keys, "n", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(QUARTILE_NAMES)], "max")
    quart = exact_quantiles(long, "value", QUARTILES, keys, QUARTILE_NAMES)
    quart = quart.select(*keys, *[rnd(c, digits).alias(c) for c in QUARTILE_NAMES])
    return long.groupBy(*keys).agg(*moments).join(quart, keys).select(*keys, "n", "mean", "std", "min", *QUARTILE_NAMES, "max")


def quantiles(df: DataFrame, col: str, qs: Sequence[float], distinct: bool = False, digits: int = 4) -> DataFrame:
    """Chosen quantiles of a column, optionally of its distinct values."""
    src = df.select(col)
    if distinct:
        src = src.distinct()
    names = [f"p{round(q * 100):02d}" for q in qs]
    out = exact_quantiles(src, col, qs, names=names)
    return out.select(*[rnd(n, digits).alias(n) for n in names])


def value_counts(df: DataFrame, value: Column, order: str = "count") -> DataFrame:
    """Rows per value, ordered by count or by value."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value") if order == "count" else counts.orderBy("value")


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin with a closed last bin; all-equal data goes to the first bin."""
    pos = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float(bins))).cast("int") + 1
    return F.coalesce(F.least(pos, F.lit(bins)), F.lit(1))


def histogram(
    df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None, digits: int = 4
) -> DataFrame:
    """Equal-width bins between minimum and maximum of the values strictly inside (low, high)."""
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    if low is not None:
        x = x.where(F.col("x") > low)
    if high is not None:
        x = x.where(F.col("x") < high)
    bounds = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = (
        x.withColumn("b", one_row(bounds))
        .groupBy(_bin(F.col("x"), F.col("b.lo"), F.col("b.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    return edges.join(counts, "bin", "left").select(
        "bin",
        rnd(F.col("lo") + (F.col("bin") - 1) * width, digits).alias("bin_low"),
        rnd(F.col("lo") + F.col("bin") * width, digits).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def kde(df: DataFrame, col: str, points: int = 50, digits: int = 6) -> DataFrame:
    """Gaussian density over an even grid from minimum to maximum, bandwidth n^(-1/5) * std.

    Equal values are counted first; each distinct value meets the fixed-size grid once and the sums
    are combined before the shuffle.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    s = one_row(
        x.agg(
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.count("x").cast("double").alias("n"),
            (F.stddev_samp("x") * F.pow(F.count("x").cast("double"), F.lit(-0.2))).alias("h"),
        )
    )
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    per_value = x.groupBy("x").agg(F.count(F.lit(1)).alias("m")).withColumn("s", s)
    at = F.col("s.lo") + F.col("i") * (F.col("s.hi") - F.col("s.lo")) / float(points - 1)
    z = (F.col("x") - F.col("at")) / F.col("s.h")
    norm = F.col("s.n") * F.col("s.h") * F.sqrt(F.lit(2.0) * F.pi())
    return (
        per_value.withColumn("i", F.explode(grid))
        .withColumn("at", at)
        .groupBy("i")
        .agg(F.max("at").alias("x"), F.sum(F.col("m") * F.exp(-z * z / 2) / norm).alias("density"))
        .select(F.col("i").alias("point"), rnd("x", 4).alias("x"), rnd("density", digits).alias("density"))
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5, digits: int = 4) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and number of outliers."""
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("x")).where("x is not null")
    quart = exact_quantiles(x, "x", QUARTILES, by, QUARTILE_NAMES)
    # equal values behave alike, so only their counts meet the quartiles
    x = x.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("m"))
    joined = x.join(quart, by) if by else x.withColumn("q", one_row(quart)).select("x", "m", "q.*")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("x") >= F.col("q1") - k * iqr) & (F.col("x") <= F.col("q3") + k * iqr)
    return joined.groupBy(*by).agg(
        F.sum("m").alias("n"),
        *[rnd(F.max(c), digits).alias(c) for c in QUARTILE_NAMES],
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("n_outliers"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Pearson correlation of every column pair (a before b), one pass over the data."""
    pairs = list(combinations(cols, 2))
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.agg(*aggs)
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    names = F.split("pair", r"\|")
    return long.select(names[0].alias("a"), names[1].alias("b"), rnd("r", digits).alias("r"))


def top_correlations(df: DataFrame, cols: Sequence[str], n: int = 20) -> DataFrame:
    """Strongest absolute correlations, without those that round to 1."""
    c = corr_matrix(df, cols).select("a", "b", F.abs("r").alias("abs_r"))
    return c.where("abs_r != 1").orderBy(F.desc("abs_r"), "a", "b").limit(n)


def grid_2d(
    df: DataFrame, x: str, y: str, bins: int, colour: str | None = None, where: Column | None = None
) -> DataFrame:
    """Two-way equal-width counts, with the mean of a third column: a scatter plot of any size."""
    base = df if where is None else df.where(where)
    cols = [F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    cols.append((F.col(colour).cast("double") if colour else F.lit(None).cast("double")).alias("c"))
    pts = base.select(*cols).where("x is not null and y is not null")
    b = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    out = (
        pts.withColumn("b", one_row(b))
        .groupBy(
            _bin(F.col("x"), F.col("b.x0"), F.col("b.x1"), bins).alias("x_bin"),
            _bin(F.col("y"), F.col("b.y0"), F.col("b.y1"), bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("c"), 4).alias("mean_colour"))
    )
    return out if colour else out.drop("mean_colour")
