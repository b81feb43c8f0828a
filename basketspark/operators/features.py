"""Binning, scaling, splitting and class balancing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_quantiles, number_rows, one_row, rnd, stable


def qcut_edges(df: DataFrame, col: str, q: int) -> Column:
    """Distinct inner and outer equal-frequency edges as an ascending array (scalar subquery)."""
    names = [f"e{i}" for i in range(q + 1)]
    edges = exact_quantiles(df, col, [i / q for i in range(q + 1)], names=names)
    return edges.select(F.array_sort(F.array_distinct(F.array(*names))).alias("edges")).scalar()


def qcut(df: DataFrame, col: str, q: int, out: str, edges_from: DataFrame | None = None) -> DataFrame:
    """Equal-frequency bin number: right-closed bins, lowest value included, equal edges merged."""
    edges = qcut_edges(df if edges_from is None else edges_from, col, q)
    x = F.col(col).cast("double")
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return (
        df.withColumn("_edges", edges)
        .withColumn("_x", x)
        .withColumn(out, F.size(F.filter(inner, lambda e: e < F.col("_x"))))
        .drop("_edges", "_x")
    )


def price_category(lines: DataFrame, out: str = "category") -> DataFrame:
    """0 below the first quartile of the distinct prices, 1 below their median, else 2."""
    cuts = one_row(exact_quantiles(lines.select("sale").distinct(), "sale", [0.25, 0.5], names=["a", "b"]))
    x = F.col("sale").cast("double")
    cat = F.when(x < F.col("_cut.a"), 0).when(x < F.col("_cut.b"), 1).otherwise(2)
    return lines.withColumn("_cut", cuts).withColumn(out, cat).drop("_cut")


def min_max_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: lowest value and range of each column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}_shift"), (F.max(x) - F.min(x)).alias(f"{c}_scale")]
    return df.agg(*aggs)


def standard_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_shift"), F.stddev_pop(x).alias(f"{c}_scale")]
    return df.agg(*aggs)


def _apply(df: DataFrame, cols: Sequence[str], params: DataFrame, lo: float, hi: float) -> DataFrame:
    scaled = {}
    for c in cols:
        z = (F.col(c).cast("double") - F.col(f"_p.{c}_shift")) / F.nullif(F.col(f"_p.{c}_scale"), F.lit(0.0))
        z = F.coalesce(z, F.when(F.col(c).isNotNull(), F.lit(0.0)))
        scaled[c] = z if (lo, hi) == (0.0, 1.0) else z * (hi - lo) + lo
    return df.withColumn("_p", one_row(params)).withColumns(scaled).drop("_p")


def min_max_scale(
    df: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0, params: DataFrame | None = None
) -> DataFrame:
    """Columns to [lo, hi]; a constant column becomes ``lo``."""
    return _apply(df, cols, params if params is not None else min_max_params(df, cols), float(lo), float(hi))


def standard_scale(df: DataFrame, cols: Sequence[str], params: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    return _apply(df, cols, params if params is not None else standard_params(df, cols), 0.0, 1.0)


def inverse_scale(
    df: DataFrame, cols: Sequence[str], params: DataFrame, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Scaled columns back to their original units."""
    back = {
        c: (F.col(c) - lo) / (hi - lo) * F.col(f"_p.{c}_scale") + F.col(f"_p.{c}_shift") for c in cols
    }
    return df.withColumn("_p", one_row(params)).withColumns(back).drop("_p")


def cluster_input(
    profile: DataFrame,
    cols: Sequence[str] = ("recency", "frequency", "monetary"),
    scaling: str = "standard",
    key: str = "customer_id",
) -> DataFrame:
    """Key and scaled attributes, written once because a clustering study reads them many times."""
    scale = {"standard": standard_scale, "min_max": min_max_scale}[scaling]
    return stable(scale(profile.select(key, *cols), cols))


def unit_hash(seed: int, *parts: Column) -> Column:
    """Reproducible number in [0, 1) from the first 32 bits of an MD5 sum."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "customer_id", test_share: float = 0.3, seed: int = 22
) -> DataFrame:
    """Add ``split`` ('train' / 'test') with the class shares kept exactly and reproducibly.

    Rows are put in a hash order within their class; the first ``floor(share * n + 1/2)`` go to test.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = number_rows(df.withColumn("_h", shuffled), ["_h", key], "_pos", by=[label])
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(test_share) + 0.5).alias("_test"))
    return (
        numbered.join(sizes, label)
        .withColumn("split", F.when(F.col("_pos") < F.col("_test"), "test").otherwise("train"))
        .drop("_h", "_pos", "_test")
    )


def class_weights(
    df: DataFrame, label: str = "label", weights: Mapping[int, float] | str | None = "balanced"
) -> DataFrame:
    """Weight per class: n / (classes * class size), given values, or 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.lit(1.0)
    elif weights == "balanced":
        totals = counts.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"))
        t = one_row(totals)
        return counts.withColumn("_t", t).select(
            label, "n", rnd(F.col("_t.n") / (F.col("_t.k") * F.col("n")), 6).alias("weight")
        )
    else:
        given = F.create_map(*[F.lit(v) for k, x in weights.items() for v in (int(k), float(x))])
        w = given[F.col(label).cast("int")]
    return counts.select(label, "n", w.alias("weight"))
