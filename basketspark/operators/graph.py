"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable


def _stars(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low2 = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) with the smallest vertex of the component as root.

    ``vertices`` has one column ``v``; ``edges`` has ``u`` and ``v`` of the same type.
    """
    e = stable(edges.where("u != v").select("u", "v").distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        e = stable(_stars(e))
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return vertices.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
