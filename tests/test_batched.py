"""Many fits and many labellings at once against one after the other."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from basketspark.operators.clustering import batched, density, metrics, partition
from basketspark.operators.spatial import distances

COLS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    at = np.concatenate([r.normal(c, 0.04, (60, 3)) for c in r.random((4, 3))] + [np.full((5, 3), 0.5)])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "customer_id long, x double, y double, z double").cache()


def test_fits_are_no_worse_than_serial_ones(spark, blobs):
    settings = [(COLS, 2), (COLS, 4), (["x", "y"], 3), (["z"], 4)]
    fits = batched.kmeans_many(blobs, settings, n_init=8)
    assert [(list(f.cols), f.k) for f in fits] == [(list(c), k) for c, k in settings]
    for f in fits:
        vec = partition.vectors(blobs, f.cols)
        serial = min(KMeans(k=f.k, maxIter=100, seed=s).fit(vec).summary.trainingCost for s in range(3))
        assert f.sse <= serial * 1.001
        labelled = blobs.withColumn("cluster", partition.nearest_centre(f.cols, f.centres))
        assert metrics.inertia(labelled, f.cols).first()["sse"] == pytest.approx(f.sse, abs=1e-3)
        assert batched.squared_silhouettes(blobs, [f])[0] == pytest.approx(
            metrics.silhouette(labelled, f.cols, mode="squared").first()["silhouette"], abs=1e-9
        )


def test_starts_do_not_depend_on_partitions(spark, blobs):
    one = batched.kmeans_many(blobs.coalesce(1), [(COLS, 5)], n_init=3)[0]
    two = batched.kmeans_many(blobs.repartition(7), [(COLS, 5)], n_init=3)[0]
    assert np.allclose(one.centres, two.centres)


def test_few_points_and_none(spark, blobs):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(4)] + [(9, 3.0, 3.0)], "customer_id long, x double, y double")
    fits = batched.kmeans_many(same, [(["x", "y"], 4), (["x"], 2)], n_init=2)
    assert [round(f.sse, 9) for f in fits] == [0, 0] and len(fits[0].centres) == 4
    assert batched.kmeans_many(same.limit(0), [(["x"], 2)]) == []
    assert partition.elbow(same.limit(0), ["x", "y"], ks=[2]).count() == 0
    with pytest.raises(ValueError):
        partition.kmeans(same.limit(0), ["x"], 2)


def test_silhouettes_of_many_labellings(spark, blobs, monkeypatch):
    monkeypatch.setattr(batched, "LABEL_COLUMNS", 6)
    names = {"a": F.col("customer_id") % 3, "b": F.lit(4), "c": F.when(F.col("x") < 0.4, -1).otherwise(7), "d": F.least("customer_id", F.lit(50))}
    wide = blobs.withColumns({k: v.cast("int") for k, v in names.items()}).withColumn("all", F.array(*names))
    got = batched.silhouettes(wide, COLS, "all", block_rows=60)
    for value, name in zip(got, names):
        want = metrics.silhouette(wide, COLS, cluster=name).first()["silhouette"]
        assert value is None if name == "b" else value == pytest.approx(want, abs=2e-4)


def test_search_keeps_every_setting(spark, blobs):
    rows = partition.feature_search(blobs, COLS, r=2, ks=(2, 3), n_init=2, mode="squared").collect()
    assert {(tuple(r["features"]), r["k"]) for r in rows} == {(c, k) for c in (("x", "y"), ("x", "z"), ("y", "z")) for k in (2, 3)}
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    exact = partition.feature_search(blobs, COLS, r=3, ks=(4,), n_init=2, mode="exact").first()
    curve = partition.elbow(blobs, COLS, ks=[4], n_init=2).first()
    assert exact["silhouette"] * 100 == pytest.approx(curve["silhouette"], abs=0.05)


@pytest.mark.parametrize("leaf_rows", [None, 24])
def test_grid_of_density_clusters(spark, leaf_rows):
    r = np.random.default_rng(6)
    at = np.concatenate([r.normal(c, 0.04, (30, 2)) for c in r.random((3, 2))] + [r.random((25, 2))]).round(2)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "customer_id long, x double, y double").cache()
    eps, mins = [0.01, 0.03, 0.07], [1, 3, 5]
    settings = [(e, m) for e in eps for m in mins]
    labels = density.dbscan_labels(df, ["x", "y"], settings, leaf_rows=leaf_rows)
    mine = df.join(labels, ["x", "y"]).orderBy("customer_id").select("labels").collect()
    for s, (e, m) in list(enumerate(settings))[::2]:
        want = [r["cluster"] for r in density.dbscan(df, ["x", "y"], e, m).orderBy("customer_id").collect()]
        got = [row["labels"][s] for row in mine]
        names = {}
        # the same groups, border points included; only the names differ
        assert all((a == -1) == (b == -1) and names.setdefault(a, b) == b for a, b in zip(got, want))
        assert len(set(names.values())) == len(names)


def test_passes_read_held_arrays_in_as_many_parts_as_cores(spark, blobs, monkeypatch):
    seen, plain = [], type(blobs).mapInPandas
    monkeypatch.setattr(type(blobs), "mapInPandas", lambda self, *args, **named: seen.append(1) or plain(self, *args, **named))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        points = batched.spread_points(blobs, COLS, "customer_id")
        fits = batched.kmeans_many(blobs, [(COLS, 3), (["x"], 2)], n_init=3, points=points)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(seen) == 1 and points.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(len(x) for _, x in points.collect()) == blobs.count()
    collected = [f.sse for f in fits]
    monkeypatch.setattr(batched, "COLLECTED", 0)
    assert [f.sse for f in batched.kmeans_many(blobs, [(COLS, 3), (["x"], 2)], n_init=3, points=points)] == pytest.approx(collected)


def test_nearest_takes_the_first_on_ties():
    r = np.random.default_rng(1)
    x, centres = r.integers(0, 3, (50, 2)).astype(float), r.integers(0, 3, (4, 5, 2)).astype(float)
    d = ((x[:, None, None] - centres[None]) ** 2).sum(axis=3)
    label, best = batched._nearest(x, centres)
    assert (label == d.argmin(axis=2)).all() and (best == d.min(axis=2)).all()


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_means_of_all_starts_at_once_equal_the_slow_ones(far):
    r = np.random.default_rng(2)
    x, centres = r.random((3, 400)) + far, r.random((6, 5, 3)) + far
    centres[1, 3] = centres[1, 2]  # a centre twice: the first one takes all points
    centres[2] = x[:, :5].T
    g = batched._Group(0, np.arange(3), np.arange(6, dtype=np.uint64), centres)
    want, got = batched._sums(x, g), batched._means(x, g)
    assert (got[..., 0] == want[..., 0]).all() and got[1, 3, 0] == 0
    assert np.allclose(got[..., 2:], want[..., 2:], rtol=1e-12)
    g.centres[:] = np.nan
    assert (batched._means(x, g)[:, 0, 0] == 400).all()


def test_silhouettes_return_one_number_a_task_and_labelling(spark, blobs, monkeypatch):
    seen, plain = [], PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, fn, schema: seen.append(schema) or plain(self, fn, schema))
    monkeypatch.setattr(batched, "SUMS", 40)
    wide = blobs.withColumn("cluster", (F.col("customer_id") % 3).cast("int"))
    both = wide.withColumn("labels", F.array("cluster", F.when(F.col("x") < 0.4, 5).otherwise(2)))
    got = batched.silhouettes(both, COLS, "labels", block_rows=7)
    # no sums of pairs of blocks are written
    assert seen == ["l int, s double"]
    assert got[0] == pytest.approx(metrics.silhouette(wide, COLS).first()["silhouette"], abs=2e-4)


def test_lengths_of_close_rows_keep_their_digits():
    r = np.random.default_rng(3)
    x = r.random((300, 3)) * 1e3 + 1e6
    y = np.concatenate([x[:200] + r.normal(0, 1e-4, (200, 3)), x[200:]])
    assert np.allclose(batched._lengths(y)(x), distances(x, y), rtol=1e-8, atol=0)
    assert (batched._lengths(x[:1])(x[:1]) == 0).all()
    assert (batched._lengths(x)(x)[np.arange(300), np.arange(300)] == 0).all()
