"""One behavioural profile per customer.

Every feature starts from a partial aggregate on (customer, basket | product | day | price), so a
customer with a huge share of the lines is spread over tasks until only those keys are left, and the
per-feature results are joined on customer while already partitioned by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entropy, one_row, rnd, whole_days
from ..sources.io import bought
from .cleaning import SPECIAL_ITEMS
from .features import qcut

CUSTOMER = "customer_id"


def _baskets(lines: DataFrame) -> DataFrame:
    return bought(lines).groupBy(CUSTOMER, "basket_id").agg(
        F.sum("qta").alias("items"),
        F.sum(F.expr("qta * sale")).alias("amount"),
        F.min("purchase_ts").alias("first_ts"),
        F.max("purchase_ts").alias("last_ts"),
    )


def basket_features(lines: DataFrame) -> DataFrame:
    """Recency, frequency, money and basket-size features."""
    last = lines.agg(F.max("purchase_ts").alias("t"))
    per = _baskets(lines).groupBy(CUSTOMER).agg(
        F.max("last_ts").alias("_last"),
        F.min("first_ts").alias("_first"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("amount").alias("_amount"),
        F.sum("items").alias("tot_items"),
        F.max("items").alias("max_items"),
        F.max("amount").alias("_max_amount"),
    )
    return per.withColumn("_g", one_row(last)).select(
        CUSTOMER,
        whole_days(F.col("_g.t"), F.col("_last")).alias("recency"),
        "frequency",
        rnd("_amount", 2).alias("monetary"),
        "tot_items",
        "max_items",
        F.expr("tot_items div frequency").alias("mean_basket_items"),
        rnd("_max_amount", 2).alias("max_sale"),
        rnd(F.col("_amount").cast("double") / F.col("frequency"), 2).alias("mean_basket_sale"),
        rnd(whole_days(F.col("_last"), F.col("_first")) / F.col("frequency"), 2).alias("purchasing_freq"),
    )


def product_features(lines: DataFrame) -> DataFrame:
    """Distinct products, entropy over products and the preferred product (smallest id on ties)."""
    per = bought(lines).groupBy(CUSTOMER, "prod_id").agg(F.sum("qta").alias("q"))
    m = F.col("q").cast("double")
    raw = F.log2(F.sum(m)) - F.sum(m * F.log2(m)) / F.sum(m)
    return per.groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("unique_items"),
        (rnd(F.greatest(raw, F.lit(0.0)), 2) + F.lit(0.0)).alias("e_prods"),
        F.min(F.struct((-F.col("q")).alias("q"), "prod_id"))["prod_id"].alias("item_pref"),
    )


def price_features(lines: DataFrame) -> DataFrame:
    """Mean of the distinct prices paid."""
    prices = bought(lines).groupBy(CUSTOMER, "sale").agg(F.lit(1).alias("_one"))
    return prices.groupBy(CUSTOMER).agg(
        rnd(F.sum("sale").cast("double") / F.count(F.lit(1)), 2).alias("mean_item_sale")
    )


def price_entropy(lines: DataFrame, bins: int = 10) -> DataFrame:
    """Entropy of the number of purchase lines per price decile; deciles come from all lines."""
    binned = qcut(bought(lines), "sale", bins, "bin", edges_from=lines)
    counts = binned.groupBy(CUSTOMER, "bin").agg(F.count(F.lit(1)).alias("m"))
    return entropy(counts, [CUSTOMER], "m", "e_sale")


def basket_entropy(lines: DataFrame, bins: int = 3) -> DataFrame:
    """Entropy of baskets per basket-amount tercile; a basket belongs to its largest customer id."""
    baskets = bought(lines).groupBy("basket_id").agg(
        F.sum(F.expr("qta * sale")).alias("amount"), F.max(CUSTOMER).alias(CUSTOMER)
    )
    counts = qcut(baskets, "amount", bins, "bin").groupBy(CUSTOMER, "bin").agg(F.count(F.lit(1)).alias("m"))
    return entropy(counts, [CUSTOMER], "m", "e_baskets")


def interval_entropy(lines: DataFrame) -> DataFrame:
    """Entropy of the week-binned gaps between successive purchase days; a single day gives 0."""
    days = bought(lines).groupBy(CUSTOMER, F.to_date("purchase_ts").alias("day")).agg(F.lit(1).alias("_one"))
    # at most one row per calendar day in a window group
    w = Window.partitionBy(CUSTOMER).orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    weeks = gaps.groupBy(CUSTOMER, F.ceil(F.col("gap") / 7).alias("week")).agg(F.count("gap").alias("m"))
    ent = entropy(weeks.where("m > 0"), [CUSTOMER], "m", "e")
    return (
        days.select(CUSTOMER)
        .distinct()
        .join(ent, CUSTOMER, "left")
        .select(CUSTOMER, F.coalesce("e", F.lit(0.0)).alias("e_intervals"))
    )


def calendar_features(lines: DataFrame) -> DataFrame:
    """Truncated mean weekday (Monday 0) and week of the month over the distinct purchase times."""
    times = bought(lines).groupBy(CUSTOMER, "purchase_ts").agg(F.lit(1).alias("_one"))
    week = F.ceil(F.dayofmonth("purchase_ts") / 7).cast("long")
    return (
        times.select(CUSTOMER, F.weekday("purchase_ts").alias("wd"), week.alias("wm"))
        .groupBy(CUSTOMER)
        .agg(F.sum("wd").alias("wd"), F.sum("wm").alias("wm"), F.count(F.lit(1)).alias("n"))
        .select(CUSTOMER, F.expr("wd div n").alias("weekday_pref"), F.expr("wm div n").alias("weekmonth_pref"))
    )


def main_country(lines: DataFrame) -> DataFrame:
    """Country with most distinct baskets; alphabetical on ties."""
    per = (
        bought(lines)
        .groupBy(CUSTOMER, "country", "basket_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy(CUSTOMER, "country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "country"))["country"]
    return per.groupBy(CUSTOMER).agg(best.alias("main_country"))


def returned_items(lines: DataFrame, exempt: Sequence[str] = SPECIAL_ITEMS) -> DataFrame:
    """Returned quantity per customer, pseudo-products left out."""
    back = lines.where((F.col("qta") < 0) & ~F.coalesce(F.col("prod_id").isin(*exempt), F.lit(False)))
    return back.groupBy(CUSTOMER).agg((-F.sum("qta")).alias("returned"))


def customer_profile(lines: DataFrame) -> DataFrame:
    """All 20 features of every customer with a purchase."""
    parts = [
        basket_features(lines),
        product_features(lines),
        price_features(lines),
        price_entropy(lines),
        basket_entropy(lines),
        interval_entropy(lines),
        calendar_features(lines),
        main_country(lines),
    ]
    # a basket shared by two customers counts for one of them only, hence the outer side
    joined = reduce(lambda a, b: a.join(b, CUSTOMER, "left"), parts).join(returned_items(lines), CUSTOMER, "left")
    p_return = F.coalesce(rnd(F.col("returned") / F.col("tot_items") * 100.0, 2), F.lit(0.0))
    return joined.select(
        CUSTOMER,
        "recency",
        "frequency",
        "monetary",
        "tot_items",
        "max_items",
        "mean_basket_items",
        "unique_items",
        p_return.alias("p_return"),
        "max_sale",
        "mean_basket_sale",
        "mean_item_sale",
        "e_prods",
        "e_sale",
        F.coalesce("e_baskets", F.lit(0.0)).alias("e_baskets"),
        "e_intervals",
        "purchasing_freq",
        "weekday_pref",
        "weekmonth_pref",
        "item_pref",
        "main_country",
    )
