"""Cluster quality scores and descriptions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import rnd, stable
from ..spatial import _PAIRS, distances
from ..stats import box_stats

BLOCK_ROWS = 2000
#: rows meet in so many blocks, if those have ``BLOCK_ROWS`` then and no more than ``MOST_ROWS``
BLOCKS, MOST_ROWS = 24, 250_000


def _squares(cols: Sequence[str], other: str) -> F.Column:
    parts = [(F.col(c) - F.col(f"{other}{c}")) * (F.col(c) - F.col(f"{other}{c}")) for c in cols]
    return sum(parts[1:], parts[0])


def centroids(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """One row per cluster: size and mean of each column."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols]
    )


def silhouette_points(
    df: DataFrame,
    cols: Sequence[str],
    key: str = "customer_id",
    cluster: str = "cluster",
    block_rows: int | None = None,
) -> DataFrame:
    """(key, cluster, a, b, s) with Euclidean distances; a single-member cluster scores 0.

    Every point needs its distance sum to every cluster, which is quadratic work. Rows are hashed to
    blocks of bounded size and each task meets two blocks, measures each pair once for both of its rows and returns
    per-cluster sums only. Blocks grow with the table, so that a row is sent to few tasks.
    """
    cols = list(cols)
    pts = stable(df.select(key, F.col(cluster).cast("int").alias("c"), *[F.col(x).cast("double").alias(x) for x in cols]))
    n = pts.count()
    n_blocks = max(1, -(-n // (block_rows or max(BLOCK_ROWS, min(n // BLOCKS, MOST_ROWS)))))
    own = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    left = pts.withColumn("i", own).withColumn("j", F.explode(F.sequence("i", F.lit(n_blocks - 1))))
    # renamed, so that the two sides of the same table stay apart
    right = pts.select(
        F.col(key).alias("o_key"), own.alias("j2"), F.col("c").alias("o"), *[F.col(x).alias(f"o_{x}") for x in cols]
    ).withColumn("i2", F.explode(F.sequence(F.lit(0), F.col("j2"))))

    def block(d: pd.DataFrame, cluster: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, pos = np.unique(d[cluster].to_numpy(), return_inverse=True)
        return d[columns].to_numpy(dtype=float), names, np.eye(len(names))[pos]

    def rows(keys: pd.Series, own: pd.Series, names: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(
            {
                key: np.repeat(keys.to_numpy(), len(names)),
                "c": np.repeat(own.to_numpy(), len(names)),
                "o": np.tile(names, len(keys)),
                "total": total.ravel(),
            }
        )

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({key: [], "c": [], "o": [], "total": []})
        same = a["i"].iloc[0] == a["j"].iloc[0]
        (ax, a_names, a_member), (bx, b_names, b_member) = block(a, "c", cols), block(b, "o", [f"o_{x}" for x in cols])
        to_b, to_a = np.zeros((len(a), len(b_names))), np.zeros((len(b), len(a_names)))
        for t in range(0, len(b), 1024):
            other = slice(t, t + 1024)
            for s in range(0, len(a), step := _PAIRS // 1024):
                d = distances(ax[s : s + step], bx[other])
                to_b[s : s + step] += d @ b_member[other]
                if not same:
                    to_a[other] += (a_member[s : s + step].T @ d).T
        out = rows(a[key], a["c"], b_names, to_b)
        return out if same else pd.concat([out, rows(b["o_key"], b["o"], a_names, to_a)])

    met = left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2")).applyInPandas(
        sums, f"{key} {dict(df.dtypes)[key]}, c int, o int, total double"
    )
    sizes = pts.groupBy(F.col("c").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    to_cluster = met.groupBy(key, "c", "o").agg(F.sum("total").alias("total")).join(sizes, "o")
    same = F.col("c") == F.col("o")
    ab = to_cluster.groupBy(key, "c").agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return ab.select(key, F.col("c").alias(cluster), "a", "b", F.when(F.col("a").isNull(), 0.0).otherwise(s).alias("s"))


def silhouette(
    df: DataFrame, cols: Sequence[str], key: str = "customer_id", cluster: str = "cluster", mode: str = "exact"
) -> DataFrame:
    """Mean silhouette. ``exact`` is Euclidean and quadratic; ``squared`` is linear and a different number."""
    if mode == "exact":
        s = silhouette_points(df, cols, key, cluster)
        return s.agg(F.lit(mode).alias("mode"), rnd(F.avg("s"), 4).alias("silhouette"))
    if mode != "squared":
        raise ValueError("mode must be 'exact' or 'squared'")
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=list(cols), outputCol="features").transform(
        df.select(F.col(cluster).cast("double").alias("cluster"), *[F.col(c).cast("double").alias(c) for c in cols])
    )
    value = ClusteringEvaluator(predictionCol="cluster").evaluate(vec)
    return df.sparkSession.createDataFrame([(mode, float(value))], "mode string, silhouette double")


def davies_bouldin(
    df: DataFrame, cols: Sequence[str], cluster: str = "cluster", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij.

    Pairs are of clusters only, met in blocks of bounded size; tasks return the worst ratio of each cluster.
    """
    cols = list(cols)
    cen = centroids(df, cols, cluster).select(cluster, *[F.col(c).alias(f"m_{c}") for c in cols])
    pts = df.select(cluster, *[F.col(c).cast("double").alias(c) for c in cols])
    spread = pts.join(cen, cluster).groupBy(cluster).agg(
        F.avg(F.sqrt(_squares(cols, "m_"))).alias("s"), *[F.first(f"m_{c}").alias(c) for c in cols]
    )
    table = stable(spread.withColumnRenamed(cluster, "c"))
    n_blocks = max(1, -(-table.count() // block_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    own = F.pmod(F.xxhash64("c"), F.lit(n_blocks)).cast("int")
    left = table.withColumns({"i": own, "j": every})
    right = table.select(every.alias("i2"), own.alias("j2"), F.col("c").alias("o"), F.col("s").alias("t"), *cols)

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(0, len(a) if len(b) else 0, 500):
            part = a.iloc[k : k + 500]
            gap = distances(part[cols].to_numpy(dtype=float), b[cols].to_numpy(dtype=float))
            # a cluster is not its own neighbour, nor is one in the same place
            gap[(gap == 0) | (part["c"].to_numpy()[:, None] == b["o"].to_numpy()[None])] = np.inf
            ratio = (part["s"].to_numpy(dtype=float)[:, None] + b["t"].to_numpy(dtype=float)[None]) / gap
            out.append(pd.DataFrame({"c": part["c"].to_numpy(), "r": ratio.max(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "r": []})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2"))
    scored = met.applyInPandas(worst, f"c {dict(table.dtypes)['c']}, r double").groupBy("c").agg(F.max("r").alias("r"))
    return scored.agg(rnd(F.avg("r"), 4).alias("davies_bouldin"))


def inertia(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Sum of squared distances to the cluster means."""
    cen = centroids(df, cols, cluster).select(cluster, *[F.col(c).alias(f"m_{c}") for c in cols])
    pts = df.select(cluster, *[F.col(c).cast("double").alias(c) for c in cols])
    return pts.join(cen, cluster).agg(rnd(F.sum(_squares(cols, "m_")), 4).alias("sse"))


def cluster_boxes(profile: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Box statistics of several attributes per cluster."""
    long = profile.select(cluster, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [cluster], list(cols), "attribute", "value"
    )
    return box_stats(long, "value", by=[cluster, "attribute"])


def _mode(df: DataFrame, cluster: str, col: str) -> DataFrame:
    """Most frequent value per cluster, smallest on ties, from partially aggregated counts."""
    counts = df.groupBy(cluster, col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(col).alias("v")))["v"]
    return counts.where(F.col(col).isNotNull()).groupBy(cluster).agg(best.alias(col))


def cluster_profile(profile: DataFrame, products: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, mean return share and item price, and most common preferences of each cluster."""
    out = profile.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg("p_return"), 4).alias("mean_p_return"),
        rnd(F.avg("mean_item_sale"), 4).alias("mean_mean_item_sale"),
    )
    for col in ("item_pref", "main_country", "weekday_pref", "weekmonth_pref"):
        out = out.join(_mode(profile, cluster, col), cluster)
    names = products.groupBy("prod_id").agg(F.min("prod_descr").alias("item_pref_descr"))
    return out.join(names.withColumnRenamed("prod_id", "item_pref"), "item_pref", "left")


def centroid_table(scaled: DataFrame, original: DataFrame, cols: Sequence[str], key: str = "customer_id", cluster: str = "cluster") -> DataFrame:
    """(cluster, attribute, n, scaled, original): cluster means in both units, one row per axis."""
    both = scaled.select(key, cluster, *[F.col(c).cast("double").alias(f"s_{c}") for c in cols]).join(
        original.select(key, *[F.col(c).cast("double").alias(f"o_{c}") for c in cols]), key
    )
    means = both.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[rnd(F.avg(f"s_{c}"), 4).alias(f"s_{c}") for c in cols],
        *[rnd(F.avg(f"o_{c}"), 4).alias(f"o_{c}") for c in cols],
    )
    axes = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("attribute"), F.col(f"s_{c}").alias("scaled"), F.col(f"o_{c}").alias("original"))
                for c in cols
            ]
        )
    )
    return means.select(cluster, "n", axes.alias("a")).select(cluster, "n", "a.*")
