"""Business rollups over clean purchase lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rnd
from .stats import describe

# fixed values: words left out of the frequency list
STOPWORDS = ("SET", "OF")

AMOUNT = "qta * sale"


def monthly_stats(lines: DataFrame) -> DataFrame:
    """Profit and distinct baskets per calendar month, in time order."""
    return (
        lines.groupBy(F.date_format("purchase_ts", "yyyy-MM").alias("month"))
        .agg(
            F.sum(F.expr(AMOUNT)).cast("double").alias("profit"),
            F.count_distinct("purchase_ts", "basket_id").alias("baskets"),
        )
        .orderBy("month")
    )


def country_stats(lines: DataFrame) -> DataFrame:
    """Profit and distinct baskets per country."""
    return lines.groupBy("country").agg(
        F.sum(F.expr(AMOUNT)).cast("double").alias("profit"), F.count_distinct("basket_id").alias("baskets")
    )


def rollup_correlation(rollup: DataFrame, a: str = "profit", b: str = "baskets") -> DataFrame:
    return rollup.agg(rnd(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 4).alias("r"))


def percent_of_total(rollup: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Each column as a percentage of its sum."""
    totals = rollup.agg(F.struct(*[F.sum(c).cast("double").alias(c) for c in cols]).alias("t")).scalar()
    keep = [c for c in rollup.columns if c not in cols]
    share = [rnd(F.col(c).cast("double") * 100.0 / F.col(f"_t.{c}"), digits).alias(c) for c in cols]
    return rollup.withColumn("_t", totals).select(*keep, *share)


def one_vs_rest(rollup: DataFrame, key: str, value: str, cols: Sequence[str]) -> DataFrame:
    """One group against the sum of all others."""
    new = F.when(F.col(key) == value, F.col(key)).otherwise(F.lit("Others"))
    return rollup.groupBy(new.alias(key)).agg(*[F.sum(c).alias(c) for c in cols])


def fold_small_groups(
    rollup: DataFrame, key: str, leave_out: str, size: str, cols: Sequence[str], threshold: float = 25
) -> DataFrame:
    """Without the main group, groups below the threshold become ``Others``."""
    new = F.when(F.col(size) >= threshold, F.col(key)).otherwise(F.lit("Others"))
    return (
        rollup.where(F.col(key) != leave_out).groupBy(new.alias(key)).agg(*[F.sum(c).alias(c) for c in cols])
    )


def activity_long(lines: DataFrame) -> DataFrame:
    """Amount per country and month with the country's rank by number of active months."""
    amounts = lines.groupBy("country", F.date_format("purchase_ts", "yyyy-MM").alias("month")).agg(
        F.sum(F.expr(AMOUNT)).cast("double").alias("amount")
    )
    ranks = (
        amounts.groupBy("country")
        .agg(F.count(F.lit(1)).alias("active_months"))
        # one row per country
        .select("country", (F.row_number().over(Window.orderBy("active_months", "country")) - 1).alias("rank"))
    )
    return amounts.join(ranks, "country").select("month", "country", "amount", "rank")


def activity_matrix(lines: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """Month by country; active cells hold the country's rank."""
    long = activity_long(lines)
    grouped = long.groupBy("month")
    pivoted = grouped.pivot("country", list(countries)) if countries else grouped.pivot("country")
    return pivoted.agg(F.max("rank")).orderBy("month")


def top_purchased(lines: DataFrame, n: int = 10) -> DataFrame:
    return (
        lines.where("qta > 0")
        .groupBy("prod_descr")
        .agg(F.sum("qta").alias("qta"))
        .orderBy(F.desc("qta"), "prod_descr")
        .limit(n)
    )


def top_returned(lines: DataFrame, n: int = 10) -> DataFrame:
    return (
        lines.where("qta < 0")
        .groupBy("prod_descr")
        .agg(F.sum("qta").alias("qta"))
        .orderBy("qta", "prod_descr")
        .limit(n)
    )


def distinct_products(lines: DataFrame, approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct("prod_id") if approximate else F.count_distinct("prod_id")
    return lines.agg(n.alias("n_products"))


def word_frequency(
    df: DataFrame, col: str = "prod_descr", stopwords: Sequence[str] = STOPWORDS, n: int = 10
) -> DataFrame:
    """Most frequent white-space separated words over all lines; texts are split where they are read."""
    words = df.select(F.explode(F.split(col, r"\s+")).alias("word")).where("word != ''")
    if stopwords:
        words = words.where(~F.col("word").isin(*stopwords))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def catalog_prices(lines: DataFrame) -> DataFrame:
    """Statistics of the distinct (product, price) pairs."""
    return describe(lines.select("prod_id", "sale").distinct(), ["sale"])


def buy_return_split(lines: DataFrame) -> DataFrame:
    """Quantity statistics of purchases and of the rest."""
    return describe(lines.withColumn("bought", F.col("qta") > 0), ["qta"], by=["bought"])


def basket_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("basket_id").agg(
        F.sum("qta").alias("qta"), F.sum(F.expr(AMOUNT)).cast("double").alias("amount")
    )
