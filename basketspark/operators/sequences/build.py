"""Customers' baskets as sequences.

The working form is flat, one row per (sequence, position, item): neither a customer nor a basket with
very many lines ever becomes one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import by_group_size, scan


def min_basket_customers(lines: DataFrame, n: int) -> DataFrame:
    """Lines of customers with at least ``n`` distinct baskets."""
    keep = lines.groupBy("customer_id").agg(F.count_distinct("basket_id").alias("_n")).where(F.col("_n") >= n)
    return lines.join(keep.select("customer_id"), "customer_id", "left_semi")


def basket_positions(lines: DataFrame, order: str = "time", max_group_rows: int | None = None) -> DataFrame:
    """(seq_id, basket_id, ts, pos): a customer's baskets numbered from 0.

    ``time`` orders by the basket's last timestamp and breaks ties by basket id; ``basket`` by id alone.
    """
    by = {"time": ["ts", "basket_id"], "basket": ["basket_id"]}[order]
    baskets = lines.groupBy(F.col("customer_id").alias("seq_id"), "basket_id").agg(F.max("purchase_ts").alias("ts"))
    one = baskets.withColumn("_one", F.lit(1).cast("long"))

    def step(d: DataFrame) -> DataFrame:
        return scan(d, ["seq_id"], by, {"pos": ("sum", "_one")}, exclusive=True)

    return by_group_size(one, ["seq_id"], by, step, max_group_rows).drop("_one")


def occurrences(
    lines: DataFrame, item: str = "prod_id", order: str = "time", max_group_rows: int | None = None
) -> DataFrame:
    """(seq_id, pos, ts, item, qta): every distinct item of every basket with its quantity."""
    items = lines.groupBy(F.col("customer_id").alias("seq_id"), "basket_id", F.col(item).alias("item")).agg(
        F.sum("qta").alias("qta")
    )
    places = basket_positions(lines, order, max_group_rows)
    return items.join(places, ["seq_id", "basket_id"]).select("seq_id", "pos", "ts", "item", "qta")


def sequentialize(lines: DataFrame, item: str = "prod_id") -> DataFrame:
    """(seq_id, pos, ts, items): one row per event with its sorted distinct items."""
    return (
        occurrences(lines, item)
        .groupBy("seq_id", "pos", "ts")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def from_events(events: DataFrame) -> DataFrame:
    """Flat occurrences of a (seq_id, pos, ts, items) table."""
    return events.select("seq_id", "pos", "ts", F.explode(F.array_distinct("items")).alias("item"))
