"""Hierarchies against the textbook one-merge-at-a-time loop."""

import numpy as np
import pandas as pd
import pytest

from basketspark.operators.clustering import density, forest, linkage
from basketspark.operators.spatial import distances

COLS = ["x", "y"]


def points(n=70, seed=0, copies=8):
    rng = np.random.default_rng(seed)
    xy = rng.normal(0, 1, (n, 2)) + rng.integers(0, 3, (n, 1)) * 4
    xy[:copies] = xy[0]
    return pd.DataFrame({"id": rng.permutation(n) + 1, "x": xy[:, 0], "y": xy[:, 1]})


def brute(pdf, method, p):
    d = distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy(), p)
    groups = [[i] for i in range(len(pdf))]
    heights = []
    reduce = {"complete": np.max, "average": np.mean, "single": np.min}[method]
    while len(groups) > 1:
        best = min(
            (reduce(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return np.sort(heights)


def brute_cut(pdf, method, p, h):
    d = distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy(), p)
    groups = [[i] for i in range(len(pdf))]
    reduce = {"complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        best = min(
            (reduce(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        if best[0] > h:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(int(pdf["id"].iloc[i]) for i in g) for g in groups}


@pytest.mark.parametrize(
    "method,metric,finish", [("complete", "euclidean", 12), ("average", "manhattan", 500)]
)
def test_linkage_equals_loop(spark, method, metric, finish):
    pdf = points(40, seed=1)
    df = spark.createDataFrame(pdf)
    merges = linkage.linkage(df, COLS, method, metric, key="id", neighbours=4, finish=finish, chunk_rows=4)
    rows = merges.toPandas()
    p = 2 if metric == "euclidean" else 1
    assert len(rows) == len(pdf) - 1
    assert np.allclose(np.sort(rows["height"]), brute(pdf, method, p))
    assert rows["size"].max() == len(pdf)
    got = linkage.cut(merges, df, 2.5, key="id").toPandas()
    assert {frozenset(g["id"]) for _, g in got.groupby("cluster")} == brute_cut(pdf, method, p, 2.5)


def test_single_linkage_tree(spark):
    pdf = points(40, seed=2, copies=4)
    df = spark.createDataFrame(pdf)
    tree = linkage.single_linkage_tree(df, COLS, key="id", leaf_rows=16)
    heights = np.sort(tree.toPandas()["height"])
    assert np.allclose(heights, brute(pdf, "single", 2))
    cuts = {r["height"]: r["n_clusters"] for r in linkage.cut_sizes(tree, len(pdf), [0.5, 1.0]).collect()}
    for h, n in cuts.items():
        assert n == density.single_linkage(df, COLS, h, key="id").select("cluster").distinct().count()
    assert linkage.last_merges(tree, 3).count() == 3


def least_tree(pdf):
    """Links of the spanning tree by (length, smaller id, larger id)."""
    ids, d = pdf["id"].to_numpy(), distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy())
    links = sorted((d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))
    root, out = {i: i for i in ids}, set()
    for w, a, b in links:
        ra, rb = root[a], root[b]
        if ra != rb:
            root = {k: ra if v == rb else v for k, v in root.items()}
            out.add((int(a), int(b), float(w)))
    return out


@pytest.mark.parametrize("limit", [0, 50_000])
def test_single_linkage_tree_with_ties_across_leaves(spark, monkeypatch, limit):
    monkeypatch.setattr(forest, "COLLECTED_LINKS", limit)
    rng = np.random.default_rng(5)
    xy = np.unique(np.concatenate([rng.integers(0, 9, (90, 2)), rng.integers(40, 44, (20, 2)), [[100, 0]]]), axis=0)
    pdf = pd.DataFrame({"id": rng.permutation(len(xy)), "x": xy[:, 0] / 7, "y": xy[:, 1] / 7})
    tree = linkage.single_linkage_tree(spark.createDataFrame(pdf), COLS, key="id", leaf_rows=5).collect()
    assert {(r["left"], r["right"], r["height"]) for r in tree} == least_tree(pdf)


def test_single_linkage_tree_sends_few_points_to_other_leaves(spark, monkeypatch):
    sent, plain = [], forest.meet
    monkeypatch.setattr(forest, "meet", lambda routed, *rest: sent.append(routed.count()) or plain(routed, *rest))
    xy = np.random.default_rng(8).random((1500, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "id long, x double, y double")
    assert linkage.single_linkage_tree(df, COLS, key="id", leaf_rows=100).count() == 1499
    # every point went to several leaves in every round
    assert len(sent) < 9 and max(sent) < 750
