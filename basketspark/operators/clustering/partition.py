"""Centre-based clustering: k-means, x-means, fuzzy c-means, mixtures, evolved centres.

The driver holds only centres and their aggregates. Pass points that are cheap to read again, such as
the checkpointed result of ``features.cluster_input``: every iteration is a pass over them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import rnd, stable
from ..spatial import _blocks, build_index
from .batched import TASK_ROWS, kmeans_many, silhouettes, spread_points, squared_silhouettes
from .metrics import davies_bouldin, inertia, silhouette

#: the search for centres cuts its points into about so many cells, of no fewer rows; their neighbourhoods are tried first
CELLS, CELL_ROWS, ROUGH_CELLS = 1024, 64, 192
Centres = Sequence[Sequence[float]]


def _sq(cols: Sequence[str], centre: Sequence[float]) -> str:
    """SQL text of the squared distance to a centre: with hundreds of terms, text is quick to build."""
    return " + ".join(f"(`{c}` - ({float(m)!r}D)) * (`{c}` - ({float(m)!r}D))" for c, m in zip(cols, centre))


def _distances(cols: Sequence[str], centres: Centres) -> str:
    return f"array({', '.join(_sq(cols, m) for m in centres)})"


def nearest_centre(cols: Sequence[str], centres: Centres) -> Column:
    """Position of the closest centre, the first one on ties."""
    d = _distances(cols, centres)
    return F.expr(f"cast(array_position({d}, array_min({d})) - 1 AS int)")


def vectors(df: DataFrame, cols: Sequence[str], key: str = "customer_id") -> DataFrame:
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(wide)


def lloyd(
    df: DataFrame, cols: Sequence[str], start: Centres, iterations: int, digits: int = 6
) -> tuple[DataFrame, list[list[float]]]:
    """k-means steps from fixed centres; returns the points with ``cluster`` and the last centres.

    Each step is one map-side combined aggregate with k rows. Centres are rounded so that the order
    of summation cannot move a point.
    """
    cols = list(cols)
    centres = [list(map(float, m)) for m in start]
    for _ in range(iterations):
        sums = (
            df.groupBy(nearest_centre(cols, centres).alias("cluster"))
            .agg(*[rnd(F.avg(c), digits).alias(c) for c in cols])
            .collect()
        )
        for row in sums:
            centres[row["cluster"]] = [row[c] for c in cols]
    return df.withColumn("cluster", nearest_centre(cols, centres)), centres


def kmeans(
    df: DataFrame, cols: Sequence[str], k: int, n_init: int = 10, max_iter: int = 100, seed: int = 22, key: str = "customer_id"
) -> tuple[DataFrame, list[list[float]], float]:
    """Best of ``n_init`` k-means++ starts, run side by side: (points with ``cluster``, centres, sum of squared errors)."""
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    fits = kmeans_many(wide, [(cols, k)], n_init, max_iter, seed, key)
    if not fits:
        raise ValueError("there are no points to cluster")
    return wide.withColumn("cluster", nearest_centre(cols, fits[0].centres)), fits[0].centres, fits[0].sse


def _combined(sse: float, sil: float, k: int) -> float:
    return -sse / 100 + sil * 100 - (k / 2) ** 2


def elbow(
    df: DataFrame,
    cols: Sequence[str],
    ks: Sequence[int] = range(2, 31),
    n_init: int = 10,
    max_iter: int = 100,
    mode: str = "exact",
    key: str = "customer_id",
) -> DataFrame:
    """One row per k: sse / 100, silhouette * 100 and their combined score.

    All starts of all k share their passes over the points, and all labellings share one visit of the pairs.
    """
    points = spread_points(df, cols, key)
    fits = kmeans_many(df, [(cols, k) for k in ks], n_init, max_iter, key=key, points=points)
    if mode == "exact":
        labels = F.array(*[nearest_centre(cols, f.centres) for f in fits])
        wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
        sils = silhouettes(wide.withColumn("labels", labels), cols, "labels", key) if fits else []
    else:
        sils = squared_silhouettes(df, fits, key, points) if fits else []
    rows = [(f.k, f.sse / 100, (s or 0.0) * 100, _combined(f.sse, s or 0.0, f.k)) for f, s in zip(fits, sils)]
    return df.sparkSession.createDataFrame(rows, "k int, sse double, silhouette double, score double")


def feature_search(
    df: DataFrame,
    cols: Sequence[str],
    r: int = 3,
    ks: Sequence[int] = (3, 4, 5, 6),
    n_init: int = 10,
    max_iter: int = 1000,
    mode: str = "squared",
    key: str = "customer_id",
) -> DataFrame:
    """Combined score of every r-subset of the (scaled) columns and every k, best first.

    All starts of all settings share their passes over the points. ``squared`` silhouettes take two more passes for all
    settings; ``exact`` ones visit the pairs once a subset.
    """
    points = spread_points(df, cols, key)
    settings = [(combo, k) for combo in itertools.combinations(cols, r) for k in ks]
    fits = kmeans_many(df, settings, n_init, max_iter, key=key, points=points)
    if mode == "squared":
        sils = squared_silhouettes(df, fits, key, points) if fits else []
    elif mode == "exact":
        sils = []
        for i in range(0, len(fits), len(ks)):
            own = fits[i].cols
            wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in own])
            labels = F.array(*[nearest_centre(own, f.centres) for f in fits[i : i + len(ks)]])
            sils += silhouettes(wide.withColumn("labels", labels), own, "labels", key)
    else:
        raise ValueError("mode must be 'exact' or 'squared'")
    rows = [(list(f.cols), f.k, f.sse, s, _combined(f.sse, s or 0.0, f.k)) for f, s in zip(fits, sils)]
    schema = "features array<string>, k int, sse double, silhouette double, score double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("score"), "k", "features")


def partition_scores(labelled: DataFrame, cols: Sequence[str], key: str = "customer_id") -> DataFrame:
    """Sum of squared errors, silhouette and Davies-Bouldin score of a clustering, one row."""
    a = inertia(labelled, cols).scalar()
    b = davies_bouldin(labelled, cols).scalar()
    return silhouette(labelled, cols, key).select(
        a.alias("sse"), "silhouette", b.alias("davies_bouldin")
    )


# ---- x-means ------------------------------------------------------------------------------------


def _bic(sizes: Sequence[int], sse: float, dims: int) -> float:
    """Bayesian information criterion of a spherical mixture (Pelleg & Moore, 2000); larger is better."""
    n, k = sum(sizes), len(sizes)
    if n <= k or sse <= 0:
        return -np.inf if n <= k else np.inf
    var = sse / (dims * (n - k))
    like = sum(m * np.log(m / n) for m in sizes if m) - n * dims / 2 * np.log(2 * np.pi * var) - dims * (n - k) / 2
    return like - (k - 1 + k * dims + 1) / 2 * np.log(n)


def xmeans(df: DataFrame, cols: Sequence[str], k_max: int = 100, steps: int = 8, key: str = "customer_id") -> tuple[DataFrame, list[list[float]]]:
    """Start from one centre and split clusters while the criterion improves.

    All clusters try their split in the same jobs: each point knows its cluster and compares the two
    child centres of that cluster, so a round costs ``steps`` aggregates over the data.
    """
    cols = list(cols)
    wide = stable(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]))
    first = wide.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centres = [[first[c] for c in cols]]
    frozen: set[tuple[float, ...]] = set()
    while len(centres) < k_max:
        near = wide.withColumn("c", nearest_centre(cols, centres))
        stats = {
            r["c"]: r
            for r in near.groupBy("c")
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.avg(c).alias(c) for c in cols],
                *[F.var_pop(c).alias(f"v_{c}") for c in cols],
            )
            .collect()
        }
        open_ = [i for i in stats if tuple(centres[i]) not in frozen and stats[i]["n"] > 2]
        if not open_:
            break
        child = {}
        for i in open_:
            mean = np.array([stats[i][c] for c in cols])
            spread = np.sqrt([max(stats[i][f"v_{c}"], 0.0) for c in cols])
            child[i] = (mean - spread, mean + spread)

        def side() -> Column:
            cases = " ".join(
                f"WHEN c = {i} THEN cast({_sq(cols, b)} < {_sq(cols, a)} AS int)" for i, (a, b) in child.items()
            )
            return F.expr(f"CASE {cases} END")

        rows = []
        for _ in range(steps):
            rows = (
                near.withColumn("s", side())
                .where("s is not null")
                .groupBy("c", "s")
                .agg(
                    F.count(F.lit(1)).alias("n"),
                    *[F.avg(c).alias(c) for c in cols],
                    *[F.var_pop(c).alias(f"v_{c}") for c in cols],
                )
                .collect()
            )
            moved = {i: list(ab) for i, ab in child.items()}
            for r in rows:
                moved[r["c"]][r["s"]] = np.array([r[c] for c in cols])
            shift = max(float(np.abs(a - b).max()) for i in child for a, b in zip(moved[i], child[i]))
            child = {i: tuple(ab) for i, ab in moved.items()}
            if shift < 1e-6:
                break
        new, split = [], False
        for i, m in enumerate(centres):
            parts = [r for r in rows if r["c"] == i]
            if i in child and len(parts) == 2:
                n = stats[i]["n"]
                sse_one = n * sum(stats[i][f"v_{c}"] for c in cols)
                sse_two = sum(r["n"] * sum(r[f"v_{c}"] for c in cols) for r in parts)
                better = _bic([r["n"] for r in parts], sse_two, len(cols)) > _bic([n], sse_one, len(cols))
                if better and len(new) + len(centres) - i + 1 <= k_max:
                    new += [[float(x) for x in ab] for ab in child[i]]
                    split = True
                    continue
            if i in stats:
                kept = [float(stats[i][c]) for c in cols]
                frozen.add(tuple(kept))
                new.append(kept)
        centres = new
        if not split:
            break
    return wide.withColumn("cluster", nearest_centre(cols, centres)), centres


# ---- fuzzy c-means ------------------------------------------------------------------------------


def farthest_start(df: DataFrame, cols: Sequence[str], k: int, key: str = "customer_id") -> list[list[float]]:
    """The first point by key, then repeatedly the point farthest from the chosen ones."""
    cols = list(cols)
    at = F.struct(*cols)
    centres: list[list[float]] = []
    for _ in range(k):
        if not centres:
            pick = F.min(F.struct(F.col(key).alias("o"), at.alias("at")))
        else:
            gap = F.expr(f"array_min({_distances(cols, centres)})")
            pick = F.min(F.struct((-gap).alias("g"), F.col(key).alias("o"), at.alias("at")))
        row = df.agg(pick.alias("p")).first()["p"]["at"]
        centres.append([float(row[c]) for c in cols])
    return centres


def _memberships(cols: Sequence[str], centres: Centres, m: float) -> Column:
    """Array of membership degrees; a point on a centre belongs to it alone."""
    d = _distances(cols, centres)
    power = f"{1.0 / (m - 1.0)!r}D"
    total = "aggregate({}, 0.0D, (acc, v) -> acc + v)"
    on_centre = f"transform({d}, x -> if(x = 0, 1.0D, 0.0D))"
    # division by zero is an error in ANSI mode, so the regular branch never sees a zero distance
    inverse = f"transform({d}, x -> pow(1.0D / if(x = 0, 1.0D, x), {power}))"
    shares = "transform({0}, v -> v / {1})"
    return F.expr(
        f"if(array_min({d}) = 0, {shares.format(on_centre, total.format(on_centre))}, "
        f"{shares.format(inverse, total.format(inverse))})"
    )


def fuzzy_cmeans(
    df: DataFrame,
    cols: Sequence[str],
    start: Centres,
    m: float = 2.0,
    iterations: int = 100,
    tolerance: float = 0.001,
    digits: int = 6,
) -> tuple[DataFrame, list[list[float]]]:
    """Soft clustering; adds ``memberships`` and the hard ``cluster`` of the largest one.

    Every iteration is a single one-row aggregate over the points.
    """
    cols = list(cols)
    centres = [list(map(float, c)) for c in start]
    for _ in range(iterations):
        u = df.withColumn("u", _memberships(cols, centres, m))
        aggs = []
        for j in range(len(centres)):
            w = f"pow(u[{j}], {float(m)!r}D)"
            aggs += [rnd(F.expr(f"sum({w} * `{c}`) / sum({w})"), digits).alias(f"c{j}_{c}") for c in cols]
        row = u.agg(*aggs).first()
        new = [[row[f"c{j}_{c}"] for c in cols] for j in range(len(centres))]
        shift = max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if shift <= tolerance:
            break
    out = df.withColumn("memberships", _memberships(cols, centres, m))
    hard = (F.array_position("memberships", F.array_max("memberships")) - 1).cast("int")
    return out.withColumn("cluster", hard), centres


# ---- mixture ------------------------------------------------------------------------------------


def gaussian_mixture(df: DataFrame, cols: Sequence[str], k: int = 5, seed: int = 22, max_iter: int = 100, key: str = "customer_id") -> tuple[DataFrame, DataFrame]:
    """Expectation maximisation: (points with ``cluster`` and ``probability``, one row per component)."""
    vec = vectors(df, cols, key).persist(StorageLevel.MEMORY_AND_DISK)
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster").fit(vec)
    components = []
    for i, g in enumerate(model.gaussians):
        components.append(
            (i, float(model.weights[i]), [float(x) for x in g.mean.toArray()], [float(x) for x in g.cov.toArray().ravel()])
        )
    schema = "cluster int, weight double, mean array<double>, covariance array<double>"
    vec.unpersist()
    out = model.transform(vec).select(key, *cols, "cluster", vector_to_array("probability").alias("probability"))
    return out, df.sparkSession.createDataFrame(components, schema)


# ---- evolved centres ----------------------------------------------------------------------------


@dataclass
class _Cells:
    """Groups of points that lie together: sizes, means, sums of squared distances to the mean, and boxes."""

    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def coarse(self, most: int) -> _Cells:
        """Neighbouring cells put together, ``most`` of them at the most."""
        groups = _blocks(self.mean, max(1, -(-2 * len(self.n) // most)))
        n = np.array([self.n[g].sum() for g in groups])
        mean = np.array([self.n[g] @ self.mean[g] / self.n[g].sum() for g in groups])
        scatter = np.array(
            [self.scatter[g].sum() + self.n[g] @ ((self.mean[g] - m) ** 2).sum(axis=1) for g, m in zip(groups, mean)]
        )
        return _Cells(n, mean, scatter, np.array([self.lo[g].min(axis=0) for g in groups]), np.array([self.hi[g].max(axis=0) for g in groups]))

    def errors(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each (candidate, cell): squared distances to the centre nearest to the cell's mean; whether another centre is
        nearer somewhere in the cell; a bound that the sum of the squared distances to the nearest centres isn't below."""
        mid, half = (self.lo + self.hi) / 2, (self.hi - self.lo) / 2
        total, open_, low = np.empty((3, len(candidates), len(self.n)))
        for s in range(0, len(candidates), step := max(1, (1 << 16) // max(1, len(self.n) * candidates.shape[1]))):
            part = candidates[s : s + step]
            to_mid, to_mean = np.zeros((2, len(part), part.shape[1], len(self.n)))
            for c in range(part.shape[2]):
                for d, at in ((to_mid, mid), (to_mean, self.mean)):
                    gap = part[:, :, c, None] - at[None, None, :, c]
                    d += np.multiply(gap, gap, out=gap)
            own = to_mean.argmin(axis=1)
            # a difference of two squared distances is linear, so it is largest in a corner of the box
            gain = np.take_along_axis(to_mid, own[:, None], 1) - to_mid
            for c in range(part.shape[2]):
                column = part[:, :, c]
                gap = np.abs(np.take_along_axis(column, own, 1)[:, None] - column[:, :, None])
                gain += np.multiply(gap, 2 * half[None, None, :, c], out=gap)
            gain = gain.max(axis=1)
            rows = slice(s, s + step)
            total[rows] = self.scatter + self.n * np.take_along_axis(to_mean, own[:, None], 1)[:, 0]
            open_[rows] = ~(gain <= 0)
            low[rows] = np.maximum(total[rows] - self.n * gain, 0.0)
        return total, open_ > 0, low


def _open_errors(blocks: Iterable[tuple[int, np.ndarray]], candidates: np.ndarray, first: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Sum for each candidate of the squared distances to its nearest centre, over the points of the cells that ask for it:
    cell i asks for ``asked[first[i] : first[i + 1]]``."""
    total = np.zeros(len(candidates))
    for cell, x in blocks:
        who = asked[first[cell] : first[cell + 1]]
        if not len(who):
            continue
        centres = candidates[who]
        step = max(1, (1 << 15) // len(who))
        for s in range(0, len(x), step):
            part, near = x[s : s + step], None
            for j in range(centres.shape[1]):
                d = np.zeros((len(who), len(part)))
                for c in range(part.shape[1]):
                    gap = centres[:, j, c, None] - part[None, :, c]
                    d += np.multiply(gap, gap, out=gap)
                near = d if near is None else np.minimum(near, d, out=near)
            total[who] += near.sum(axis=1)
    return total


def _cells(df: DataFrame, cols: list[str]) -> tuple[_Cells, RDD]:
    """(figures of the cells, their points as arrays that executors hold: (number of the cell, points))."""
    index = build_index(df.select(*cols), cols, CELL_ROWS, CELLS)
    each = [F.avg(c).alias(f"m_{c}") for c in cols] + [F.var_pop(c).alias(f"v_{c}") for c in cols]
    t = index.points.groupBy("leaf").agg(*each).orderBy("leaf").toPandas()
    n = index.boxes.rows.astype(float)
    mean, spread = (t[[f"{a}_{c}" for c in cols]].to_numpy(dtype=float).reshape(len(t), len(cols)) for a in "mv")
    cells = _Cells(n, mean, n * spread.sum(axis=1), index.boxes.lo, index.boxes.hi)
    leaves = index.boxes.leaf

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [(int(np.searchsorted(leaves, leaf)), part[cols].to_numpy(dtype=float)) for leaf, part in batch.groupby("leaf")]
            yield pd.DataFrame({"cell": [i for i, _ in own], "x": [np.ascontiguousarray(x).tobytes() for _, x in own]})

    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-int(n.sum()) // TASK_ROWS))
    spread = index.points.repartition(tasks, "leaf").sortWithinPartitions("leaf", *cols)
    made = stable(spread.mapInPandas(pack, "cell int, x binary")).rdd
    points = made.map(lambda row: (row["cell"], np.frombuffer(row["x"], float).reshape(-1, len(cols))))
    return cells, points.persist(StorageLevel.MEMORY_AND_DISK)


def evolve_centres(
    df: DataFrame,
    cols: Sequence[str],
    k: int = 4,
    population: int = 500,
    generations: int = 2000,
    mutated_genes: int = 1,
    seed: int = 22,
    key: str = "customer_id",
) -> tuple[DataFrame, list[list[float]], float]:
    """Genetic search over centre sets; input scaled to a bounded range.

    Points are cut into a fixed number of cells, of which the driver holds sizes, means and boxes. Where one centre is the
    nearest in all of a cell, its points' errors follow from these; a child that is surely worse than all candidates so far
    is dropped by the same figures. Only the other cells' points are measured, by tasks that return one number per
    candidate. Selection, crossover and mutation work on the small table of candidates.
    """
    cols = list(cols)
    wide = stable(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]))
    bounds = wide.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    lo = np.array([bounds[f"lo_{c}"] for c in cols])
    hi = np.array([bounds[f"hi_{c}"] for c in cols])
    rng = np.random.default_rng(seed)
    pop = rng.uniform(lo, hi, size=(population, k, len(cols)))
    cells, points = _cells(wide, cols)
    rough = cells.coarse(ROUGH_CELLS)

    def score(candidates: np.ndarray, limit: float = np.inf) -> np.ndarray:
        """Errors of the candidates; infinite for some of those above the limit."""
        out = np.full(len(candidates), np.inf)
        left = np.arange(len(candidates))
        if np.isfinite(limit):
            left = left[~(rough.errors(candidates)[2].sum(axis=1) > limit * (1 + 1e-9))]
        total, open_, low = cells.errors(candidates[left])
        if np.isfinite(limit):
            kept = ~(low.sum(axis=1) > limit * (1 + 1e-9))
            left, total, open_ = left[kept], total[kept], open_[kept]
        out[left] = np.where(open_, 0.0, total).sum(axis=1)
        cell, asked = np.nonzero(open_.T)
        if len(cell):
            own, first = candidates[left], np.searchsorted(cell, np.arange(len(cells.n) + 1))
            asked = asked.astype(np.int32)
            out[left] += np.sum(points.mapPartitions(lambda blocks: [_open_errors(blocks, own, first, asked)]).collect(), axis=0)
        return out

    fitness = score(pop)
    for _ in range(generations):
        # parents by tournament, one crossover point per child, a few mutated genes
        a, b = rng.integers(0, population, (2, 2, population))
        parents = np.where(fitness[a[0]] < fitness[a[1]], a[0], a[1])
        others = np.where(fitness[b[0]] < fitness[b[1]], b[0], b[1])
        cut = rng.integers(1, k * len(cols), population)
        genes = np.arange(k * len(cols))[None] < cut[:, None]
        flat = pop.reshape(population, -1)
        children = np.where(genes, flat[parents], flat[others])
        for _ in range(mutated_genes):
            at = rng.integers(0, k * len(cols), population)
            dim = at % len(cols)
            children[np.arange(population), at] = rng.uniform(lo[dim], hi[dim])
        children = children.reshape(pop.shape)
        child_fitness = score(children, fitness.max())
        both = np.concatenate([pop, children])
        both_fitness = np.concatenate([fitness, child_fitness])
        keep = np.argsort(both_fitness, kind="stable")[:population]
        pop, fitness = both[keep], both_fitness[keep]
    best = int(fitness.argmin())
    centres = [[float(v) for v in m] for m in pop[best]]
    return wide.withColumn("cluster", nearest_centre(cols, centres)), centres, float(fitness[best])
