"""Connected components over links of any shape, hubs included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketspark.functions import stable

HUB_LINKS = 1000
MAX_HUBS = 100_000


def _with_smallest(pairs: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the smallest neighbour of ``u`` from ``low`` (u, m, n).

    A vertex with many links would put all of them into one task of a join. Such hubs are broadcast instead: no more
    than ``pairs`` divided by the threshold can exist, so the threshold grows with the links and bounds the table.
    """
    limit = max(HUB_LINKS, 2 * links // MAX_HUBS)
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    few = pairs.join(hubs, "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return few.unionByName(pairs.join(hubs, "u"))


def _step(e: DataFrame, links: int) -> DataFrame:
    """Link every larger neighbour to the smallest one, then every vertex and its smaller neighbours to the smallest."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    up = _with_smallest(both, low, links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    up = up.where("u != v").distinct()
    down = up.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_smallest(down, low, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (u, v of one type): the smallest vertex of its component.

    Alternating large and small stars (Kiveris et al., 2014); rounds grow with the logarithm of the longest path. Each
    round's links are written to the checkpoint folder. Null ends and loops are left out; without links there are no rows.
    """
    e = stable(links.where("u != v").select("u", "v").distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        e = stable(_step(e, now[0]))
    ends = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return ends.unionByName(e.select("v", F.col("v").alias("root")).distinct())
