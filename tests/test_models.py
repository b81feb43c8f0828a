"""Seeded clusterings on three clear groups of points, by properties and against numpy."""

from collections import Counter

import numpy as np
import pytest

from basketspark.operators.classify import models, neighbours
from basketspark.operators.clustering import metrics, partition
from basketspark.operators.spatial import _blocks

COLS = ["x", "y"]
MIDDLES = np.array([[0.1, 0.1], [0.8, 0.2], [0.4, 0.9]])


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(1)
    rows = [
        (30 * g + i, *map(float, m + r.normal(0, 0.03, 2)), g) for g, m in enumerate(MIDDLES) for i in range(30)
    ]
    return spark.createDataFrame(rows, "customer_id long, x double, y double, label int").cache()


def groups(df):
    """The clusters' label sets; three of one label each if the groups were found."""
    found = {}
    for r in df.select("cluster", "customer_id").collect():
        found.setdefault(r.cluster, set()).add(r.customer_id // 30)
    return sorted(tuple(x) for x in found.values())


FOUND = [(0,), (1,), (2,)]


def test_kmeans_and_elbow(blobs):
    out, centres, sse = partition.kmeans(blobs, COLS, 3, n_init=3)
    x = np.array(blobs.select(*COLS).collect())
    d = ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2)
    assert groups(out) == FOUND and sse == pytest.approx(d.min(axis=1).sum())
    _, start = partition.lloyd(blobs, COLS, [[0.0, 0.0], [0.1, 0.0], [0.2, 0.0]], 2)
    assert sse <= ((x[:, None] - np.array(start)[None]) ** 2).sum(axis=2).min(axis=1).sum() + 1e-9
    rows = partition.elbow(blobs, COLS, ks=range(2, 5), n_init=2).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4] and rows[0].sse > rows[1].sse > rows[2].sse
    assert max(rows, key=lambda r: r.silhouette).k == 3


def test_squared_silhouette_equals_numpy(blobs):
    x, c = np.array(blobs.select(*COLS).collect()), np.array([r.label for r in blobs.select("label").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    s = []
    for i in range(len(x)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    got = metrics.silhouette(blobs, COLS, cluster="label", mode="squared").first().silhouette
    assert got == pytest.approx(np.mean(s))


def test_xmeans_splits_two_groups_only_if_allowed(blobs):
    # of three groups equally far apart the criterion rightly refuses a first split in two, so two are given
    two = blobs.where("label < 2")
    out, centres = partition.xmeans(two, COLS)
    assert len(centres) >= 2 and all(len(g) == 1 for g in groups(out))
    assert len(partition.xmeans(two, COLS, k_max=1)[1]) == 1


def test_soft_clusterings(blobs):
    start = partition.farthest_start(blobs, COLS, 3)
    out, _ = partition.fuzzy_cmeans(blobs, COLS, start)
    assert groups(out) == FOUND
    assert all(sum(r.memberships) == pytest.approx(1) for r in out.collect())
    points, parts = partition.gaussian_mixture(blobs, COLS, 3)
    assert all(sum(r.probability) == pytest.approx(1) for r in points.collect())
    assert sum(r.weight for r in parts.collect()) == pytest.approx(1)


def test_evolution_never_loses_its_best(blobs):
    runs = [partition.evolve_centres(blobs, COLS, 3, population=20, generations=g) for g in (0, 4)]
    assert runs[1][2] <= runs[0][2]
    x = np.array(blobs.select(*COLS).collect())
    d = ((x[:, None] - np.array(runs[1][1])[None]) ** 2).sum(axis=2)
    assert runs[1][2] == pytest.approx(d.min(axis=1).sum())


def test_evolution_equals_loop_without_a_query_for_each_generation(blobs, monkeypatch):
    seen, plain = [], type(blobs).mapInPandas
    monkeypatch.setattr(type(blobs), "mapInPandas", lambda self, *args, **named: seen.append(1) or plain(self, *args, **named))
    _, centres, sse = partition.evolve_centres(blobs, COLS, 3, population=12, generations=6)
    assert len(seen) == 1
    x = np.array(blobs.select(*COLS).collect())
    lo, hi, rng = x.min(axis=0), x.max(axis=0), np.random.default_rng(22)

    def score(pop):
        return np.array([((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() for c in pop])

    n = 3 * len(COLS)
    pop = rng.uniform(lo, hi, size=(12, 3, len(COLS)))
    fitness = score(pop)
    for _ in range(6):
        a, b = rng.integers(0, 12, (2, 2, 12))
        one, two = (np.where(fitness[p[0]] < fitness[p[1]], p[0], p[1]) for p in (a, b))
        head = np.arange(n)[None] < rng.integers(1, n, 12)[:, None]
        children = np.where(head, pop.reshape(12, -1)[one], pop.reshape(12, -1)[two])
        at = rng.integers(0, n, 12)
        children[np.arange(12), at] = rng.uniform(lo[at % len(COLS)], hi[at % len(COLS)])
        both = np.concatenate([pop, children.reshape(pop.shape)])
        scores = np.concatenate([fitness, score(both[12:])])
        keep = np.argsort(scores, kind="stable")[:12]
        pop, fitness = both[keep], scores[keep]
    assert sse == pytest.approx(fitness.min()) and np.allclose(centres, pop[fitness.argmin()])


@pytest.fixture(scope="module")
def noisy(spark):
    """The groups again, wider and of unequal size, with a few wrong labels."""
    r = np.random.default_rng(2)
    rows = []
    for g, (m, n) in enumerate(zip(MIDDLES, (60, 40, 20))):
        for i in range(n):
            x, y = m + r.normal(0, 0.08, 2)
            rows.append((len(rows), float(x), float(y), (g + 1) % 3 if i % 15 == 7 else g))
    return spark.createDataFrame(rows, "customer_id long, x double, y double, label int").cache()


MAJORITY = 0.5


def accuracy(predicted):
    rows = predicted.collect()
    assert len({r.customer_id for r in rows}) == len(rows)
    assert all(sum(r.scores) == pytest.approx(1) for r in rows)
    return sum(r.label == r.prediction for r in rows) / len(rows)


def test_trees_and_leaves(noisy):
    train, test = noisy.where("customer_id % 4 != 0"), noisy.where("customer_id % 4 = 0")
    tree = models.decision_tree(train, COLS, max_depth=4)
    assert accuracy(models.predict(tree, test)) > 0.8 > MAJORITY
    forest = models.random_forest(train, COLS, n_trees=10, max_depth=5)
    assert accuracy(models.predict(forest, test)) > 0.8
    by = {r.split: r.accuracy for r in models.train_test_scores(tree, train, test).collect()}
    assert by["train"] == pytest.approx(accuracy(models.predict(tree, train)), abs=1e-4)
    assert by["test"] == pytest.approx(accuracy(models.predict(tree, test)), abs=1e-4)
    leaves = models.leaf_profile(tree, train, COLS).collect()
    total = Counter()
    for r in leaves:
        assert r.n == sum(r.class_counts.values()) and r.class_counts[r.majority] == max(r.class_counts.values())
        assert r.min_x <= r.max_x and r.min_y <= r.max_y
        total.update(r.class_counts)
    assert total == Counter(r.label for r in train.select("label").collect())
    assert all(r.leaf == s.leaf or r.max_x < s.min_x or s.max_x < r.min_x or r.max_y < s.min_y or s.max_y < r.min_y
               for r in leaves for s in leaves)


def test_kernel_machine_and_network(noisy):
    train, test = noisy.where("customer_id % 4 != 0"), noisy.where("customer_id % 4 = 0")
    for got in models.rbf_svm(train, [train, test], COLS, c=10.0, gamma=10.0, size=32, max_iter=30):
        assert accuracy(got) > 0.8
    model, loss = models.mlp(train, COLS, hidden=(8, 4), max_iter=120)
    losses = [r.loss for r in loss.orderBy("iteration").collect()]
    assert losses[-1] < losses[0] and accuracy(models.predict(model, test)) > 0.8


def test_network_is_trained_on_all_cores(spark, noisy, monkeypatch):
    seen, plain = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    models.mlp(noisy.coalesce(1), ["x", "y"], hidden=(4,), max_iter=3)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_grid_searches(noisy):
    model, out = models.grid_search(noisy, COLS, "decision_tree", {"impurity": ["gini", "entropy"], "maxDepth": [1, 4]})
    rows = out.collect()
    assert {r.setting for r in rows} == {f"impurity={i}, maxDepth={d}" for i in ("gini", "entropy") for d in (1, 4)}
    assert [r.accuracy for r in rows] == sorted((r.accuracy for r in rows), reverse=True)
    assert "maxDepth=4" in rows[0].setting and model.bestModel.getMaxDepth() == 4
    svm = models.svm_grid_search(noisy, COLS, [0.5, 5.0], gammas=["scale", 10.0], size=16, max_iter=15, n_folds=2).collect()
    assert {(r.gamma, r.c) for r in svm} == {(g, c) for g in ("scale", "10.0") for c in (0.5, 5.0)}
    assert [(-r.accuracy, r.gamma, r.c) for r in svm] == sorted((-r.accuracy, r.gamma, r.c) for r in svm)
    assert all(0.8 < r.accuracy < 1 for r in svm)  # wrong labels can't all be right
    with pytest.raises(ValueError):
        models.svm_grid_search(noisy, COLS, [0.0, 1.0])


@pytest.mark.parametrize("weights", [None, {0: 0.1, 1: 0.3, 2: 0.6}])
def test_tree_grid_fits_one_tree_for_all_depths(noisy, monkeypatch, weights):
    grid = {"impurity": ["gini", "entropy"], "maxDepth": [1, 3, 6, 12]}
    fits, fit = [], models.DecisionTreeClassifier._fit
    monkeypatch.setattr(models.DecisionTreeClassifier, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    _, out = models.grid_search(noisy, COLS, "decision_tree", grid, weights)
    assert len(fits) == 2 * 3 + 1  # impurities, folds, and the best on all rows
    data = models.assemble(models.add_weights(models.stratified_folds(noisy), weights), COLS).cache()
    judge = models.MulticlassClassificationEvaluator(metricName="accuracy")
    for impurity in grid["impurity"]:
        for depth in grid["maxDepth"]:
            tree = models.DecisionTreeClassifier(weightCol="weight", seed=22, impurity=impurity, maxDepth=depth)
            each = [judge.evaluate(tree.fit(data.where(f"fold != {f}")).transform(data.where(f"fold = {f}"))) for f in range(3)]
            got = out.where(f"setting = 'impurity={impurity}, maxDepth={depth}'").first().accuracy
            assert got == pytest.approx(sum(each) / 3, abs=1e-12)


def test_knn_grid_equals_loop(noisy):
    df = models.stratified_folds(noisy)
    rows = df.collect()
    per = Counter((r.label, r.fold) for r in rows)
    assert all(max(per[c, f] for f in range(3)) - min(per[c, f] for f in range(3)) <= 1 for c in range(3))
    got = {(r.p, r.weights, r.k): r.accuracy for r in neighbours.knn_grid_search(df, COLS, (1, 4, 7)).collect()}
    assert len(got) == 12
    for (p, weights, k), value in got.items():
        hits = 0
        for a in rows:
            near = []
            for b in rows:
                if b.fold != a.fold:
                    dx, dy = abs(a.x - b.x), abs(a.y - b.y)
                    near.append((dx + dy if p == 1 else (dx * dx + dy * dy) ** 0.5, b.customer_id, b.label))
            votes = Counter()
            for d, _, label in sorted(near)[:k]:
                votes[label] += 1 if weights == "uniform" else 1 / d
            hits += min(votes, key=lambda c: (-votes[c], c)) == a.label
        assert value == pytest.approx(hits / len(rows), abs=1e-6)


def test_evolution_measures_only_points_between_centres():
    r = np.random.default_rng(3)
    x, candidates = r.random((4000, 3)), r.random((30, 4, 3))
    rows = _blocks(x, 64)
    mean = np.array([x[b].mean(axis=0) for b in rows])
    cells = partition._Cells(
        np.array([float(len(b)) for b in rows]),
        mean,
        np.array([((x[b] - m) ** 2).sum() for b, m in zip(rows, mean)]),
        np.array([x[b].min(axis=0) for b in rows]),
        np.array([x[b].max(axis=0) for b in rows]),
    )
    want = ((x[None, :, None] - candidates[:, None]) ** 2).sum(axis=3).min(axis=2).sum(axis=1)
    total, open_, low = cells.errors(candidates)
    cell, asked = np.nonzero(open_.T)
    first = np.searchsorted(cell, np.arange(len(rows) + 1))
    rest = partition._open_errors(((i, x[b]) for i, b in enumerate(rows)), candidates, first, asked)
    assert np.allclose(np.where(open_, 0, total).sum(axis=1) + rest, want)
    assert (low.sum(axis=1) <= want).all() and (cells.coarse(16).errors(candidates)[2].sum(axis=1) <= want).all()
    assert 0 < open_.mean() < 0.7 and len(cells.coarse(16).n) <= 16
