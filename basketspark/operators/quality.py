"""Data-quality checks; each returns its findings as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_overview(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "column", "non_null")
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return long.select("column", types[F.col("column")].alias("type"), "non_null")


def cancel_sign_check(raw: DataFrame) -> DataFrame:
    """Cancelled rows, cancelled rows with positive quantity, negative rows outside cancellations."""
    c = F.col("basket_id").contains("C")
    return raw.agg(
        F.count_if(c).alias("cancelled"),
        F.count_if(c & (F.col("qta") > 0)).alias("cancelled_positive"),
        F.count_if(~c & (F.col("qta") < 0) & F.col("customer_id").isNotNull()).alias("negative_not_cancelled"),
    )


def match_cancellations(
    raw: DataFrame,
    attrs: Sequence[str] = ("prod_id", "sale", "qta"),
    compare: str = "abs",
) -> DataFrame:
    """Cancelled baskets whose lines equal those of another basket of the same customer.

    A basket is reduced to an order-free 128-bit signature of its lines with a partially aggregated
    sum, so a huge basket never sits in one row; purchases are grouped by signature before the join,
    so copies do not multiply. ``compare='raw'`` keeps the sign of the quantity.
    """
    if compare not in ("abs", "raw"):
        raise ValueError("compare must be 'abs' or 'raw'")
    cols = [F.abs(c) if c == "qta" and compare == "abs" else F.col(c) for c in attrs]
    h1 = F.xxhash64(*cols).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("second"), *cols).cast("decimal(38,0)")
    baskets = raw.where("customer_id is not null").groupBy("customer_id", "basket_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(h1).alias("h1"), F.sum(h2).alias("h2")
    )
    is_c = F.col("basket_id").contains("C")
    sig = ["customer_id", "n_lines", "h1", "h2"]
    purchases = (
        baskets.where(~is_c)
        .groupBy(*sig)
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min("basket_id").alias("first_match"))
    )
    return (
        baskets.where(is_c)
        .join(purchases, sig)
        .select("customer_id", "basket_id", "n_lines", "n_matches", "first_match")
    )


def duplicate_products(raw: DataFrame) -> DataFrame:
    """Lines repeating a product in a basket at one single price, without nulls."""
    key = ["basket_id", "basket_ts", "prod_id"]
    repeated = (
        raw.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.min("sale").alias("lo"), F.max("sale").alias("hi"))
        .where("n > 1 and lo = hi")
        .select(*key)
    )
    return raw.join(repeated, key, "left_semi").na.drop()


def fd_violations(df: DataFrame, key: str, dep: str) -> DataFrame:
    """Keys that do not determine exactly one non-null value of ``dep``."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count_distinct(dep).alias("n_distinct"))
        .where("n_distinct != 1")
    )


def pair_cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) pairs without nulls against distinct a."""
    pairs = df.select(a, b).na.drop().groupBy(a, b).agg(F.lit(1).alias("one"))
    n_pairs = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count_distinct(a).alias("n_keys")).select(n_pairs.alias("n_pairs"), "n_keys")


def cooccurring_items(df: DataFrame, marker: str, item: str = "prod_id") -> DataFrame:
    """Lines that share a basket with ``marker`` without being it."""
    marked = df.where(F.col(item) == marker).select("basket_id").distinct()
    return df.where(F.col(item) != marker).join(marked, "basket_id", "left_semi")


def odd_basket_ids(raw: DataFrame) -> DataFrame:
    """Baskets holding letters other than the cancellation mark."""
    b = F.col("basket_id")
    return raw.where(b.rlike("[A-Za-z]") & ~b.contains("C")).select("basket_id").distinct()


def odd_product_ids(raw: DataFrame) -> DataFrame:
    """Products whose id has letters and no digit."""
    p = F.col("prod_id")
    return raw.where(p.rlike("[A-Za-z]") & ~p.rlike("[0-9]")).select("prod_id", "prod_descr").distinct()


def odd_descriptions(raw: DataFrame) -> DataFrame:
    """Distinct descriptions with a lower-case letter."""
    return raw.where(F.col("prod_descr").rlike("[a-z]")).select("prod_descr").distinct()


def null_descriptions(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(F.col("prod_descr").isNull()).alias("n_null"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def excess_decimals(raw: DataFrame) -> DataFrame:
    """Rows whose price text shows three or more decimals."""
    return raw.where(F.col("sale").rlike(r",\d{3,}"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row on every column."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))
