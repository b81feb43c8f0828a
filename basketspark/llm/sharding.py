"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stable

OVERHEAD = 16
WHOLE_GROUP = 0.1


def byte_shards(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = OVERHEAD,
    whole_group: float = WHOLE_GROUP,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows are ordered by text hash, then id. A range partitioning on that order is written out once; its partition
    totals, one row each, give every partition its offset, and a running sum inside the partition does the rest, so
    neither a hot text nor the whole table meets in one task. Shard ``s`` holds the rows whose middle byte is in the
    ``s``-th of ``n_shards`` equal parts of all bytes. Equal texts lie side by side; the at most ``n_shards - 1`` groups
    that a cut would divide stay whole in the first of its shards, unless they hold more than ``whole_group`` of a
    shard. ``slot`` counts a shard's rows from 0.

    A null text has the bytes of an empty one (crc32 0); null ids sort first; repeated rows are rows like others.
    An empty table gives no rows. What is carried is shuffled twice, so leave the text out where the places are
    enough. Columns of ``docs`` that are called like a new one are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    made = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in carry or docs.columns if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(id_col).alias("k"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
    )
    rows = stable(rows.repartitionByRange("h", "k").withColumn("pid", F.spark_partition_id()))
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(  # one row per partition
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("pid").orderBy("h", "k")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)

    part = F.expr(f"cast(cast(2 * start + size as decimal(28,0)) * {n_shards} div (2 * total) as int)")
    placed = (
        rows.withColumn("s", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .withColumn("r", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "pid")
        .select("row", "h", "size", "crc", "total", (F.col("bytes0") + F.col("s")).alias("start"),
                (F.col("row0") + F.col("r")).alias("place"))
        .withColumn("own", part)
    )
    placed = stable(placed)
    cut = (
        placed.groupBy("h")
        .agg(
            F.min("own").alias("first"), F.max("own").alias("last"), F.sum("size").alias("bytes"), F.max("total").alias("t")
        )
        .where("first < last")
        .where(F.col("bytes") * n_shards <= F.col("t") * whole_group)
        .select("h", F.col("first").alias("whole"))
    )
    # a cut lies in one group, so this side has fewer rows than there are shards
    placed = placed.join(F.broadcast(cut), "h", "left").withColumn("shard", F.coalesce("whole", "own"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("place0"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "row.*", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("place0")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard is dealt by its number, so no shard is cut over tasks."""
    dealt = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
