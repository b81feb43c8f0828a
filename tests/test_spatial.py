"""Index, nearest neighbours and density clusters against brute force on small, skewed data."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from basketspark.operators import spatial
from basketspark.operators.clustering import density, metrics
from basketspark.operators.graph import connected_components
from basketspark.operators.spatial import box_table, build_index, distances, knn

COLS = ["x", "y"]


def points(n=260, seed=0):
    """A dense spot, a third of exact copies, and a sparse rest."""
    rng = np.random.default_rng(seed)
    dense = rng.normal(0.3, 0.01, (n // 3, 2))
    copies = np.repeat([[0.8, 0.8]], n // 3, axis=0)
    sparse = rng.uniform(0, 1, (n - 2 * (n // 3), 2))
    xy = np.concatenate([dense, copies, sparse])
    return pd.DataFrame({"id": rng.permutation(n) + 1, "x": xy[:, 0], "y": xy[:, 1]})


def brute_dbscan(pdf, eps, min_pts):
    pdf = pdf.sort_values("id", ignore_index=True)
    d = distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy())
    near = d <= eps
    core = near.sum(axis=1) >= min_pts
    label = np.full(len(pdf), -1)
    cluster = 0
    for i in range(len(pdf)):
        if not core[i] or label[i] >= 0:
            continue
        label[i] = cluster
        todo = [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if label[j] < 0:
                    label[j] = cluster
                    if core[j]:
                        todo.append(j)
        cluster += 1
    return dict(zip(pdf["id"], label))


def test_index_splits_until_small(spark):
    pdf = points().drop_duplicates(COLS)
    index = build_index(spark.createDataFrame(pdf), COLS, leaf_rows=10)
    assert len(index.boxes.leaf) > 5
    assert index.boxes.rows.max() <= 20
    assert index.points.count() == len(pdf)
    assert index.boxes.rows.sum() == len(pdf)
    again = box_table(index.points, COLS)
    assert np.array_equal(again.lo, index.boxes.lo)


@pytest.mark.parametrize("p", [1, 2])
def test_knn_is_exact(spark, p):
    pdf = points(seed=1)
    df = spark.createDataFrame(pdf)
    q = df.withColumnRenamed("id", "query_id")
    pts = df.withColumnRenamed("id", "point_id")
    got = knn(q, pts, COLS, 4, p=p, leaf_rows=12).toPandas()
    s = pdf.sort_values("id")
    d = distances(pdf[COLS].to_numpy(), s[COLS].to_numpy(), p)
    order = d.argsort(axis=1, kind="stable")[:, :4]
    want = {(int(qid), r + 1): int(s["id"].iloc[order[i, r]]) for i, qid in enumerate(pdf["id"]) for r in range(4)}
    assert {(r.query_id, r.rank): r.point_id for r in got.itertuples()} == want


def test_knn_visits_few_leaves(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(20_000), **dict(zip("xyz", rng.uniform(0, 1, (3, 20_000))))}))
    visits, real = [], spatial.meet

    def counted(routed, *rest):
        visits.append(routed.count())
        return real(routed, *rest)

    monkeypatch.setattr(spatial, "meet", counted)
    pts = df.withColumnRenamed("id", "point_id")
    index = build_index(pts, list("xyz"), 200)
    assert len(index.boxes.leaf) == 64
    knn(df.withColumnRenamed("id", "query_id"), pts, list("xyz"), 9, p=1, leaf_rows=200)
    assert visits[0] == 20_000 and sum(visits) < 10 * 20_000
    print("leaves per query", sum(visits) / 20_000)


@pytest.mark.parametrize("p", [1, 2])
def test_knn_in_many_columns_sends_a_query_to_few_leaves(spark, monkeypatch, p):
    rng = np.random.default_rng(8)
    cols = [f"c{i}" for i in range(9)]
    pdf = pd.DataFrame(rng.uniform(0, 1, (3000, 9)).round(1), columns=cols).assign(point_id=rng.permutation(3000))
    asked = pd.DataFrame(rng.uniform(0, 1, (200, 9)).round(1), columns=cols).assign(query_id=np.arange(200))
    visits, real = [], spatial.meet

    def counted(routed, *rest):
        met = real(routed, *rest)
        visits.append((routed.count(), met.count()))
        return met

    monkeypatch.setattr(spatial, "meet", counted)
    monkeypatch.setattr(spatial, "LEAF_ROWS", 8)
    got = knn(spark.createDataFrame(asked), spark.createDataFrame(pdf), cols, 6, p=p).toPandas()
    pdf = pdf.sort_values("point_id")
    d = distances(asked[cols].to_numpy(), pdf[cols].to_numpy(), p)
    order = d.argsort(axis=1, kind="stable")[:, :6]
    want = {(q, r + 1): (int(pdf["point_id"].iloc[order[q, r]]), d[q, order[q, r]]) for q in range(200) for r in range(6)}
    assert {(r.query_id, r.rank): (r.point_id, r.dist) for r in got.itertuples()} == want
    # leaves of 8 rows would be hundreds; and a visit returns only what lies as near as the neighbours found at home
    assert visits[1][0] < 100 * 200 and visits[1][1] < 0.5 * 6 * visits[1][0]


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_rows_keeps_ties_and_reach(p):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 4, (60, 6)).astype(float), rng.integers(0, 4, (1500, 6)).astype(float)
    y[7] = np.nan
    d = np.nan_to_num(distances(x, y, p), nan=np.inf)
    kth = np.partition(d, 4, axis=1)[:, 4]
    for reach in (None, kth, np.full(60, np.nan), kth * 0.9):
        i, j, near = spatial.nearest_rows(x, y, 5, p, reach)
        assert np.array_equal(near, d[i, j])
        limit = kth if reach is None else np.fmin(kth, reach)
        assert {(a, b) for a, b in zip(*np.nonzero(d <= limit[:, None]))} <= set(zip(i, j))
        assert len(set(zip(i, j))) == len(i)


def test_knn_with_fewer_points_than_neighbours(spark):
    pts = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "point_id long, x double")
    q = spark.createDataFrame([(1, 0.9), (2, 9.0)], "query_id long, x double")
    got = {(r.query_id, r.rank): r.point_id for r in knn(q, pts, ["x"], 5, leaf_rows=1).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 3): 3, (2, 1): 3, (2, 2): 2, (2, 3): 1}
    assert knn(q, pts.where("x > 9"), ["x"], 2).count() == 0
    assert knn(q.where("x < 0"), pts, ["x"], 2).count() == 0


@pytest.mark.parametrize("block_rows", [3, 2000])
def test_davies_bouldin_equals_numpy(spark, block_rows):
    pdf = points(120, seed=6)
    pdf["cluster"] = (pdf["x"] * 11).astype(int)
    means = pdf.groupby("cluster")[COLS].mean()
    near = np.sqrt(((pdf[COLS] - means.loc[pdf["cluster"]].to_numpy()) ** 2).sum(axis=1))
    s = near.groupby(pdf["cluster"]).mean().to_numpy()
    gap = distances(means.to_numpy(), means.to_numpy())
    np.fill_diagonal(gap, np.inf)
    want = ((s[:, None] + s[None]) / gap).max(axis=1).mean()
    got = metrics.davies_bouldin(spark.createDataFrame(pdf), COLS, block_rows=block_rows).first()[0]
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("eps,min_pts", [(0.02, 4), (0.08, 3), (0.5, 5)])
def test_dbscan_equals_brute_force(spark, eps, min_pts):
    pdf = points(seed=2)
    got = density.dbscan(spark.createDataFrame(pdf), COLS, eps, min_pts, key="id", leaf_rows=9)
    assert {r["id"]: r["cluster"] for r in got.collect()} == brute_dbscan(pdf, eps, min_pts)


def test_dbscan_grid_equals_brute_force(spark):
    pdf = points(150, seed=8)
    got = density.dbscan_grid(spark.createDataFrame(pdf), COLS, [0.02, 0.08], [3, 6], key="id").collect()
    assert [(r.eps, r.min_pts) for r in got] == [(0.02, 3), (0.02, 6), (0.08, 3), (0.08, 6)]
    d = distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy())
    for r in got:
        label = pdf["id"].map(brute_dbscan(pdf, r.eps, r.min_pts)).to_numpy()
        assert (r.n_clusters, r.n_noise) == (len(set(label) - {-1}), (label == -1).sum())
        s = []
        for i in range(len(pdf)):
            own = label == label[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
            s.append((b - a) / max(a, b))
        assert r.silhouette == pytest.approx(np.mean(s), abs=1e-4)


@pytest.mark.parametrize("leaf_rows", [6, 2048])
def test_single_linkage_is_dbscan_with_one_point(spark, leaf_rows):
    pdf = points(seed=3)
    got = density.single_linkage(spark.createDataFrame(pdf), COLS, 0.05, key="id", leaf_rows=leaf_rows)
    assert {r["id"]: r["cluster"] for r in got.collect()} == brute_dbscan(pdf, 0.05, 1)


def test_dbscan_line_with_border_points(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2, 3, 4])], "id long, x double")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, ["x"], 1.0, 3, key="id").collect()}
    assert got == {i: 0 for i in range(5)}
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2, 10, 11, 12, 6])], "id long, x double")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, ["x"], 1.0, 2, key="id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}


def test_all_noise(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0)], "id long, x double")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, ["x"], 1.0, 2, key="id").collect()}
    assert got == {1: -1, 2: -1}


def test_k_distance_and_optics(spark):
    pdf = points(120, seed=4)
    df = spark.createDataFrame(pdf)
    d = distances(pdf[COLS].to_numpy(), pdf[COLS].to_numpy())
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, 3]
    got = {r["id"]: r["dist"] for r in density.k_distance(df, COLS, 4, key="id", leaf_rows=8).collect()}
    assert got == pytest.approx(dict(zip(pdf["id"], kth)))
    radius = 0.06
    cd = np.where(kth <= radius, kth, np.nan)
    reach = np.where((d <= radius) & ~np.isnan(cd)[None], np.maximum(d, cd[None]), np.inf).min(axis=1)
    out = density.optics(df, COLS, radius, 4, key="id", leaf_rows=8).toPandas().set_index("id").loc[pdf["id"]]
    assert np.allclose(out["core_dist"].to_numpy(dtype=float), cd, equal_nan=True)
    assert np.allclose(out["reachability"].to_numpy(dtype=float), np.where(np.isinf(reach), np.nan, reach), equal_nan=True)


def test_silhouette_blocks_agree(spark):
    pdf = points(90, seed=5)
    pdf["cluster"] = (pdf["x"] * 3).astype(int)
    pdf.loc[0, "cluster"] = 9
    df = spark.createDataFrame(pdf)
    one = metrics.silhouette_points(df, COLS, "id").orderBy("id").toPandas()
    many = metrics.silhouette_points(df, COLS, "id", block_rows=11).orderBy("id").toPandas()
    assert np.allclose(one["s"], many["s"])
    assert one.loc[one["cluster"] == 9, "s"].tolist() == [0.0]


def test_silhouette_measures_a_pair_once(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), metrics.distances

    def counted(a, b, p=2):
        seen.add(len(a) * len(b))
        return real(a, b, p)

    pdf = points(300, seed=5)
    pdf["cluster"] = (pdf["x"] * 3).astype(int)
    d, c = real(pdf[COLS].to_numpy(), pdf[COLS].to_numpy()), pdf["cluster"].to_numpy()
    monkeypatch.setattr(metrics, "distances", counted)
    got = metrics.silhouette_points(spark.createDataFrame(pdf), COLS, "id", block_rows=20).toPandas().set_index("id")
    assert 300 * 300 / 2 <= seen.value < 0.7 * 300 * 300
    for i, key in enumerate(pdf["id"]):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        assert got.loc[key, "a"] == pytest.approx(a) and got.loc[key, "b"] == pytest.approx(min(d[i, c == o].mean() for o in set(c) - {c[i]}))


def test_components_on_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(300, 200)]
    v = spark.createDataFrame([(i,) for i in {x for e in edges for x in e} | {999}], "v long")
    e = spark.createDataFrame(edges, "u long, v long")
    got = {r["v"]: r["root"] for r in connected_components(v, e).collect()}
    for n, root in got.items():
        assert root == (1 if n <= 60 else 100 if n < 200 else 200 if n in (200, 300) else 999)


def test_dense_points_are_settled_without_meeting_other_leaves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(1500), "x": rng.uniform(0, 1, 1500), "y": rng.uniform(0, 1, 1500)})
    df = spark.createDataFrame(pdf)
    met, pairs = [], []
    meet, touching = density.meet, density._touching_leaves

    def counted_meet(routed, *rest):
        met.append(routed.count())
        return meet(routed, *rest)

    def counted_pairs(*args):
        found = touching(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(density, "meet", counted_meet)
    monkeypatch.setattr(density, "_touching_leaves", counted_pairs)
    got = density.dbscan(df, ["x", "y"], 0.2, 4, key="id", leaf_rows=20)
    assert {r["cluster"] for r in got.collect()} == {0}
    density.single_linkage(df, ["x", "y"], 0.2, key="id", leaf_rows=20).collect()
    # some 100 leaves, each within reach of a dozen or more
    assert max(met) < 100 and max(pairs) == 0


def test_reachability_visits_only_leaves_that_can_lower_it(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(1500), "x": rng.uniform(0, 1, 1500), "y": rng.uniform(0, 1, 1500)})
    met, meet = [], density.meet

    def counted(routed, *rest):
        met.append(routed.count())
        return meet(routed, *rest)

    monkeypatch.setattr(density, "meet", counted)
    got = density.optics(spark.createDataFrame(pdf), ["x", "y"], 0.2, 4, key="id", leaf_rows=20).toPandas()
    assert len(got) == 1500 and got["reachability"].notna().all()
    assert max(met) < 6 * 1500


def test_gaps_to_boxes_take_little_memory():
    r = np.random.default_rng(3)
    lo = r.random((40_000, 3))
    boxes = spatial.Boxes(np.arange(len(lo)), lo, lo + 0.01, np.full(len(lo), 64))
    x = r.random((boxes.row_chunk(), 3))
    tracemalloc.start()
    near, far = boxes.near(x, 2), boxes.far(x, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = np.maximum(np.maximum(lo[None] - x[:, None], x[:, None] - lo[None] - 0.01), 0)
    wide = np.maximum(np.abs(x[:, None] - lo[None]), np.abs(x[:, None] - lo[None] - 0.01))
    assert np.allclose(near, np.sqrt((gap**2).sum(axis=2))) and np.allclose(far, np.sqrt((wide**2).sum(axis=2)))
    assert most < 30e6


def test_queries_sent_to_many_leaves_are_not_written(spark, monkeypatch):
    written, plain = [], spatial.stable
    monkeypatch.setattr(spatial, "stable", lambda df: written.append(df.columns) or plain(df))
    at = np.random.default_rng(4).random((400, 6))
    cols = list("abcdef")
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "id long, " + ", ".join(f"{c} double" for c in cols))
    near = spatial.knn(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "point_id"), cols, 3, leaf_rows=20).collect()
    d = distances(at, at)
    assert all(r["dist"] == pytest.approx(np.sort(d[r["query_id"]])[r["rank"] - 1]) for r in near) and len(near) == 1200
    assert not [c for c in written if "_home" in c and "to_leaf" in c]
