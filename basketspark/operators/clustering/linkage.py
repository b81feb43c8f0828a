"""Hierarchical clustering without a distance matrix.

Complete and average linkage are reducible, so all mutually nearest pairs can merge in the same round.
The distance between two clusters is never below the distance of their centroids; a spatial search over
the centroids therefore yields a few candidates per cluster, only their exact distances are computed,
and a cluster takes part once its best exact distance beats every centroid not looked at. The last few
clusters, a fixed number, are finished on a small table.

Single linkage is the minimum spanning tree, grown by joining every component to its nearest foreign
point in each round (see ``forest``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import number_rows, stable
from ..graph import connected_components
from ..spatial import build_index, distances, knn
from .forest import spanning_forest

FINISH_CLUSTERS = 256
CHUNK_ROWS = 256
MERGES = "left long, right long, height double, size long"


def _positions(df: DataFrame, cols: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(distinct positions with pid and copies w, merges of the copies at height 0)."""
    pts = stable(df.select(F.col(key).cast("long").alias("k"), *[F.col(c).cast("double").alias(c) for c in cols]))
    spots = pts.groupBy(*cols).agg(F.min("k").alias("pid"), F.count(F.lit(1)).alias("w"))
    copies = (
        pts.join(spots, list(cols))
        .where("k != pid")
        .select(F.col("pid").alias("left"), F.col("k").alias("right"), F.lit(0.0).alias("height"), F.col("w").alias("size"))
    )
    return stable(spots), copies


def _exact(pairs: DataFrame, points: DataFrame, cols: list[str], method: str, p: int, chunk_rows: int) -> DataFrame:
    """(a, b, d): linkage distance of each cluster pair, computed chunk against chunk."""
    sizes = points.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / chunk_rows).alias("parts"), F.sum("w").alias("n")
    )
    chunks = stable(
        points.join(sizes, "cluster")
        .groupBy("cluster", "n", F.pmod(F.xxhash64("pid"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct(*cols, "w")).alias("rows"))
    )
    a = chunks.select(F.col("cluster").alias("a"), F.col("n").alias("na"), F.col("rows").alias("ra"))
    b = chunks.select(F.col("cluster").alias("b"), F.col("n").alias("nb"), F.col("rows").alias("rb"))
    met = pairs.join(a, "a").join(b, "b")

    def unpack(rows) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[r[c] for c in cols] for r in rows], dtype=float), np.array([r["w"] for r in rows], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = np.empty(len(batch))
            for i, (ra, rb) in enumerate(zip(batch["ra"], batch["rb"])):
                (xa, wa), (xb, wb) = unpack(ra), unpack(rb)
                d = distances(xa, xb, p)
                value[i] = d.max() if method == "complete" else wa @ d @ wb
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "na": batch["na"], "nb": batch["nb"], "v": value})

    part = met.mapInPandas(run, "a long, b long, na long, nb long, v double")
    if method == "complete":
        return part.groupBy("a", "b").agg(F.max("v").alias("d"))
    return part.groupBy("a", "b").agg((F.sum("v") / (F.max("na") * F.max("nb"))).alias("d"))


def _finish(matrix: np.ndarray, ids: np.ndarray, sizes: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Remaining merges of a fixed number of clusters, closest pair first."""
    d, alive, out = matrix.copy(), np.ones(len(ids), dtype=bool), []
    np.fill_diagonal(d, np.inf)
    for _ in range(len(ids) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), float(d[i, j]), int(sizes[i] + sizes[j])))
        if method == "complete":
            row = np.maximum(d[i], d[j])
        else:
            row = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j], alive[j] = np.inf, np.inf, False
        ids[i], sizes[i] = min(ids[i], ids[j]), sizes[i] + sizes[j]
    return out


def linkage(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "complete",
    metric: str = "euclidean",
    key: str = "customer_id",
    neighbours: int = 8,
    finish: int = FINISH_CLUSTERS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(left, right, height, size): every merge, clusters named by their smallest key."""
    if method not in ("complete", "average"):
        raise ValueError("method must be 'complete' or 'average'")
    cols, p = list(cols), {"euclidean": 2, "manhattan": 1}[metric]
    spark = df.sparkSession
    spots, merges = _positions(df, cols, key)
    points = stable(spots.withColumn("cluster", F.col("pid")))
    k = neighbours
    while True:
        mean = [(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in cols]
        clusters = stable(points.groupBy("cluster").agg(F.sum("w").alias("n"), *mean))
        m = clusters.count()
        if m <= finish:
            break
        near = knn(
            clusters.select(F.col("cluster").alias("query_id"), *cols),
            clusters.select(F.col("cluster").alias("point_id"), *cols),
            cols,
            k + 1,
            p=p,
        )
        near = stable(near.where("query_id != point_id"))
        pairs = near.select(
            F.least("query_id", "point_id").alias("a"), F.greatest("query_id", "point_id").alias("b")
        ).distinct()
        exact = stable(_exact(pairs, points, cols, method, p, chunk_rows))
        both = exact.select(F.col("a").alias("c"), F.col("b").alias("o"), "d").unionByName(
            exact.select(F.col("b").alias("c"), F.col("a").alias("o"), "d")
        )
        # the order (distance, smaller id, larger id) is total, so the closest pair overall is mutual
        edge = F.struct("d", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
        best = both.groupBy("c").agg(F.min(edge).alias("e")).select("c", "e.*")
        seen = near.groupBy(F.col("query_id").alias("c")).agg(F.max("dist").alias("horizon"), F.count(F.lit(1)).alias("n"))
        sure = best.join(seen, "c").where((F.col("d") < F.col("horizon") * (1 - 1e-9)) | (F.col("n") >= m - 1))
        mutual = stable(
            sure.groupBy("lo", "hi", "d").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2").select("lo", "hi", "d")
        )
        if mutual.isEmpty():
            k *= 4
            continue
        size = clusters.select(F.col("cluster").alias("lo"), F.col("n").alias("n1"))
        other = clusters.select(F.col("cluster").alias("hi"), F.col("n").alias("n2"))
        merges = merges.unionByName(
            mutual.join(size, "lo")
            .join(other, "hi")
            .select(
                F.col("lo").alias("left"), F.col("hi").alias("right"), F.col("d").alias("height"), (F.col("n1") + F.col("n2")).alias("size")
            )
        )
        renamed = mutual.select(F.col("hi").alias("cluster"), "lo")
        points = stable(points.join(renamed, "cluster", "left").withColumn("cluster", F.coalesce("lo", "cluster")).drop("lo"))
    if m > 1:
        rows = clusters.orderBy("cluster").select("cluster", "n").collect()
        ids = np.array([r["cluster"] for r in rows])
        at = {c: i for i, c in enumerate(ids.tolist())}
        # at most finish * (finish - 1) / 2 pairs
        pairs = spark.createDataFrame(
            [(int(ids[i]), int(ids[j])) for i in range(m) for j in range(i + 1, m)], "a long, b long"
        )
        matrix = np.zeros((m, m))
        for r in _exact(pairs, points, cols, method, p, chunk_rows).collect():
            matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["d"]
        last = _finish(matrix, ids, np.array([float(r["n"]) for r in rows]), method)
        merges = merges.unionByName(spark.createDataFrame(last, MERGES))
    return stable(merges)


def single_linkage_tree(
    df: DataFrame, cols: Sequence[str], metric: str = "euclidean", key: str = "customer_id", leaf_rows: int | None = None
) -> DataFrame:
    """(left, right, height): the minimum spanning tree, which holds the single-linkage merges of every height."""
    cols, p = list(cols), {"euclidean": 2, "manhattan": 1}[metric]
    spots, copies = _positions(df, cols, key)
    index = build_index(spots, cols, leaf_rows)
    points = index.points.select(F.lit(0).alias("m"), "pid", "leaf", *cols, F.lit(0.0).alias("cd"))
    found = spanning_forest(points, index.boxes, cols, p)
    tree = copies.select("left", "right", "height")
    return stable(tree.unionByName(found.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("w").alias("height"))))


def last_merges(merges: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest merges: a truncated dendrogram."""
    return merges.orderBy(F.desc("height"), "left", "right").limit(n)


def cut(merges: DataFrame, keys: DataFrame, height: float, key: str = "customer_id") -> DataFrame:
    """(key, cluster): clusters left when merges above ``height`` are undone, numbered by smallest key."""
    edges = merges.where(F.col("height") <= height).select(F.col("left").alias("u"), F.col("right").alias("v"))
    found = stable(connected_components(keys.select(F.col(key).cast("long").alias("v")), edges))
    numbered = number_rows(found.select("root").distinct(), ["root"], "cluster")
    return found.join(numbered, "root").select(F.col("v").alias(key), "cluster")


def cut_sizes(merges: DataFrame, n_points: int, heights: Sequence[float]) -> DataFrame:
    """(height, n_clusters) for several cuts, from the number of merges below each."""
    grid = F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("cut")
    below = merges.select("height", grid).groupBy("cut").agg(F.count_if(F.col("height") <= F.col("cut")).alias("m"))
    return below.select(F.col("cut").alias("height"), (F.lit(n_points) - F.col("m")).alias("n_clusters"))
