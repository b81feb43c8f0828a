"""Spending classes and the table classifiers are trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rnd, stable
from ..sources.io import bought
from .clustering.partition import kmeans, lloyd
from .features import min_max_params, min_max_scale, price_category

CUSTOMER = "customer_id"
TARGET = "mean_basket_sale"


def eligible_customers(profile: DataFrame, min_baskets: int = 2, cap: float = 3000) -> DataFrame:
    """Customers with enough baskets and a mean basket below the cap."""
    return profile.where((F.col("frequency") >= min_baskets) & (F.col(TARGET) < cap))


def eligibility_report(profile: DataFrame, min_baskets: int = 2, cap: float = 3000) -> DataFrame:
    """Customers left after each step."""
    enough = F.col("frequency") >= min_baskets
    return profile.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(enough).alias("n_enough_baskets"),
        F.count_if(enough & (F.col(TARGET) < cap)).alias("n_eligible"),
    )


def split_high_spenders(profile: DataFrame, threshold: float = 1000) -> tuple[DataFrame, DataFrame]:
    """(customers to cluster, customers set aside as high spenders)."""
    return profile.where(F.col(TARGET) < threshold), profile.where(F.col(TARGET) >= threshold)


def order_labels(labelled: DataFrame, raw: str = "cluster", value: str = TARGET) -> DataFrame:
    """Replace arbitrary cluster ids by 0, 1, 2 ... in ascending order of their values.

    The clusters of one column do not overlap, so every cluster's rank is the number of clusters with a
    smaller lowest value (exact, unlike a mean); there are only a handful of them.
    """
    lowest = labelled.groupBy(raw).agg(F.min(value).alias("_m"))
    every = lowest.agg(F.collect_list("_m").alias("m")).scalar()
    ranks = lowest.withColumn("_all", every).select(
        raw, F.size(F.filter("_all", lambda m: m < F.col("_m"))).cast("int").alias("label")
    )
    return labelled.join(ranks, raw).drop(raw)


def label_by_kmeans(
    profile: DataFrame,
    k: int = 3,
    n_init: int = 1000,
    max_iter: int = 1000,
    start: Sequence[float] | None = None,
    steps: int = 10,
    seed: int = 22,
) -> DataFrame:
    """Cluster the scaled mean basket amount and order the clusters into classes.

    ``start`` gives fixed centres on the scaled axis instead of random restarts.
    """
    scaled = stable(
        min_max_scale(profile.select(CUSTOMER, TARGET), [TARGET], params=min_max_params(profile, [TARGET]))
    )
    if start is not None:
        clustered, _ = lloyd(scaled, [TARGET], [[x] for x in start], steps)
    else:
        clustered, _, _ = kmeans(scaled, [TARGET], k, n_init, max_iter, seed)
    both = profile.join(clustered.select(CUSTOMER, "cluster"), CUSTOMER)
    return order_labels(both)


def union_high_spenders(labelled: DataFrame, high: DataFrame, label: int = 2) -> DataFrame:
    return labelled.unionByName(high.withColumn("label", F.lit(label)))


def class_thresholds(labelled: DataFrame) -> DataFrame:
    """Largest mean basket amount of each class."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(TARGET).alias("max_mean_basket_sale"))


def spending_classes(
    profile: DataFrame,
    min_baskets: int = 2,
    cap: float = 3000,
    threshold: float = 1000,
    **kmeans_options,
) -> DataFrame:
    """Eligible profiles with their ``label``: 0 low, 1 medium, 2 high."""
    low, high = split_high_spenders(eligible_customers(profile, min_baskets, cap), threshold)
    return union_high_spenders(label_by_kmeans(low, **kmeans_options), high)


def restrict_lines(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Lines of the given customers only."""
    return lines.join(customers.select(CUSTOMER).distinct(), CUSTOMER, "left_semi")


def mean_item_sale_basket(lines: DataFrame) -> DataFrame:
    """Mean over baskets of the mean price in the basket."""
    per = bought(lines).groupBy(CUSTOMER, "basket_id").agg(
        (F.sum("sale").cast("double") / F.count(F.lit(1))).alias("m")
    )
    return per.groupBy(CUSTOMER).agg(rnd(F.avg("m"), 2).alias("mean_item_sale_basket"))


def category_quantity(lines: DataFrame) -> DataFrame:
    """Per price category: mean quantity over the baskets that contain it, cut to a whole number."""
    per = (
        bought(price_category(lines))
        .groupBy(CUSTOMER, "basket_id", "category")
        .agg(F.sum("qta").alias("q"))
    )
    wide = per.groupBy(CUSTOMER).pivot("category", [0, 1, 2]).agg(F.floor(rnd(F.avg("q"), 2)).cast("long"))
    return wide.select(CUSTOMER, *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"cat{i}") for i in range(3)])


def classification_table(labelled: DataFrame, lines: DataFrame) -> DataFrame:
    """Features that do not give the class away, category quantities per basket, label last."""
    kept = restrict_lines(lines, labelled)
    joined = (
        labelled.join(mean_item_sale_basket(kept), CUSTOMER).join(category_quantity(kept), CUSTOMER)
    )
    return joined.select(
        CUSTOMER,
        "recency",
        "frequency",
        "mean_basket_items",
        "e_prods",
        "e_sale",
        "e_baskets",
        "e_intervals",
        "purchasing_freq",
        "mean_item_sale_basket",
        *[rnd(F.col(f"cat{i}") / F.col("frequency"), 2).alias(f"cat{i}") for i in range(3)],
        F.col("label").cast("int").alias("label"),
    )
