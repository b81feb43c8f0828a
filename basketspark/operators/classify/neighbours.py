"""Instance-based steps: nearest-neighbour classes and synthetic oversampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import number_rows, rnd, stable
from ..features import unit_hash
from ..spatial import knn

KEY = "customer_id"


def _vote(near: DataFrame, by: Sequence[str], weights: str) -> DataFrame:
    """Winning label per group; with distance weights an exact match outvotes everything else."""
    exact = F.col("dist") == 0
    inverse = F.lit(1.0) / F.when(exact, F.lit(None)).otherwise(F.col("dist"))
    votes = near.groupBy(*by, "label").agg(
        F.count_if(exact).alias("zero"),
        F.count(F.lit(1)).alias("all"),
        F.coalesce(F.sum(inverse), F.lit(0.0)).alias("inv"),
    )
    if weights == "uniform":
        rank: list[Column] = [-F.col("all")]
    elif weights == "distance":
        rank = [-F.col("zero"), -rnd("inv", 9)]
    else:
        raise ValueError("weights must be 'uniform' or 'distance'")
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col("label")))["label"]
    return votes.groupBy(*by).agg(best.alias("prediction"))


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    k: int = 9,
    p: int = 1,
    weights: str = "distance",
    label: str = "label",
    key: str = KEY,
    leaf_rows: int | None = None,
) -> DataFrame:
    """(key, label, prediction) of the test rows; equal votes go to the smaller class."""
    near = knn(
        test.select(F.col(key).alias("query_id"), *features),
        train.select(F.col(key).alias("point_id"), *features),
        features,
        k,
        p=p,
        leaf_rows=leaf_rows,
    )
    voted = _vote(
        near.join(train.select(F.col(key).alias("point_id"), F.col(label).alias("label")), "point_id"),
        ["query_id"],
        weights,
    )
    return test.select(key, label).join(voted.withColumnRenamed("query_id", key), key)


def knn_grid_search(
    df: DataFrame,
    features: Sequence[str],
    ks: Sequence[int],
    ps: Sequence[int] = (1, 2),
    weights: Sequence[str] = ("uniform", "distance"),
    fold: str = "fold",
    label: str = "label",
    key: str = KEY,
) -> DataFrame:
    """(p, weights, k, accuracy) by cross-validation, best first.

    One neighbour search per fold and metric, at the largest k, serves every smaller k. All votes of a row are counted from
    its list of neighbours, so the neighbours move once, not once for every k.
    """
    df = stable(df.select(key, *features, label, fold))
    if unknown := set(weights) - {"uniform", "distance"}:
        raise ValueError(f"weights must be 'uniform' or 'distance', not {sorted(unknown)}")
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    classes = np.array([r[0] for r in df.select(label).distinct().orderBy(label).collect()])
    count = _counter(sorted(ks), list(weights), classes)
    out = None
    for p in ps:
        for f in folds:
            train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
            near = knn(
                test.select(F.col(key).alias("query_id"), *features),
                train.select(F.col(key).alias("point_id"), *features),
                features,
                max(ks),
                p=p,
            )
            near = near.join(train.select(F.col(key).alias("point_id"), F.col(label).alias("label")), "point_id")
            lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "label"))).alias("near"))
            lists = lists.join(test.select(F.col(key).alias("query_id"), F.col(label).alias("truth")), "query_id")
            counted = lists.select("truth", F.col("near.dist").alias("dist"), F.col("near.label").alias("label"))
            counted = counted.mapInPandas(count, "weights string, k int, hits long, n long").groupBy("weights", "k")
            # a few rows: what the search wrote is not needed any more
            part = stable(counted.agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select(F.lit(p).alias("p"), "*"))
            out = part if out is None else out.unionByName(part)
    out = out.groupBy("p", "weights", "k").agg(rnd(F.sum("hits") / F.sum("n"), 6).alias("accuracy"))
    return out.orderBy(F.desc("accuracy"), "p", "weights", "k")


def _counter(ks: list[int], weights: list[str], classes: np.ndarray):
    """Right votes for each k, by the rules of :func:`_vote`, from rows with the distances and labels of the nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            truth, most = batch["truth"].to_numpy(), max(ks)
            dist, vote = np.full((len(batch), most), np.nan), np.zeros((len(batch), most, len(classes)))
            for i, (d, c) in enumerate(zip(batch["dist"], batch["label"])):
                d, c = d[:most], c[:most]
                dist[i, : len(d)] = d
                vote[i, np.arange(len(c)), np.searchsorted(classes, c)] = 1
            exact = dist == 0
            inverse = np.where(exact | np.isnan(dist), 0.0, 1.0 / np.where(exact, 1.0, dist))
            count, zero, inv = ((vote * w[:, :, None]).cumsum(axis=1) for w in (np.ones_like(dist), exact, inverse))
            inv = np.floor(inv * 1e9 + 0.5) / 1e9
            for k in ks:
                at = count[:, k - 1], zero[:, k - 1], inv[:, k - 1]
                for w in weights:
                    if w == "uniform":
                        best = at[0].argmax(axis=1)  # the smaller class on ties
                    else:
                        first = at[1] == at[1].max(axis=1, keepdims=True)
                        # a class without a vote never wins
                        best = np.where(first & (at[0] > 0), at[2], -1.0).argmax(axis=1)
                    yield pd.DataFrame({"weights": [w], "k": [k], "hits": [int((classes[best] == truth).sum())], "n": [len(batch)]})

    return run


def smote(
    train: DataFrame,
    features: Sequence[str],
    k: int = 5,
    seed: int = 22,
    label: str = "label",
    key: str = KEY,
) -> DataFrame:
    """Raise every class to the size of the largest with points between a row and one of its k
    nearest rows of the same class.

    Synthetic row j uses base row j mod n in key order; neighbour and step come from a hash of (seed, j),
    so the result does not depend on partitioning. A class of k rows or fewer uses all its other rows as
    neighbours; one of a single row is an error. Added columns: ``synthetic`` (null on real rows).
    """
    features = list(features)
    data = stable(train.select(F.col(key).alias("base"), *features, F.col(label).alias("label")))
    sizes = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    largest = max(sizes.values())
    out = data.select("base", F.lit(None).cast("long").alias("synthetic"), *features, "label")
    for c, n in sorted(sizes.items()):
        if n == largest:
            continue
        if n < 2:
            raise ValueError(f"class {c} has one row, which has no neighbour to move towards")
        needed, available = largest - n, min(k, n - 1)
        mine = data.where(F.col("label") == c)
        pts = mine.select(F.col("base").alias("point_id"), *features)
        near = knn(mine.select(F.col("base").alias("query_id"), *features), pts, features, available + 1)
        # the row itself is left out wherever it appears; copies may have pushed it past the end
        at_self = near.where("query_id = point_id").select("query_id", F.col("rank").alias("self_rank"))
        others = (
            near.where("query_id != point_id")
            .join(at_self, "query_id", "left")
            .withColumn("rank", F.col("rank") - F.when(F.col("self_rank") < F.col("rank"), 1).otherwise(0))
            .where(F.col("rank") <= available)
            .select(F.col("query_id").alias("base"), "rank", "point_id")
        )
        numbered = number_rows(mine, ["base"], "pos")
        rows = train.sparkSession.range(needed).select(F.col("id").alias("j"), (F.col("id") % n).alias("pos"))
        planned = numbered.join(rows, "pos").select(
            "*",
            (F.floor(unit_hash(seed, F.lit(c), F.lit("n"), F.col("j")) * available) + 1).cast("int").alias("rank"),
            unit_hash(seed, F.lit(c), F.lit("u"), F.col("j")).alias("u"),
        )
        partner = pts.select("point_id", *[F.col(f).alias(f"to_{f}") for f in features])
        made = planned.join(others, ["base", "rank"]).join(partner, "point_id")
        moved = [(F.col(f) + F.col("u") * (F.col(f"to_{f}") - F.col(f))).alias(f) for f in features]
        out = out.unionByName(made.select("base", F.col("j").alias("synthetic"), *moved, "label"))
    return out
