"""Many k-means fits in the passes of one, and the scores of many labellings in the passes of one.

A setting is a set of columns and a number of clusters; each setting has several starts. Every pass over the points
serves all of them: tasks return one row per cluster of each start, partial sums over their points, so what moves
depends on the settings alone. Starts that have settled leave the passes that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ...functions import number_rows, rnd, stable
from ..spatial import _PAIRS, distances

#: distances of points to one cluster of all starts that are worked on at a time, so that they stay in a core's cache
CELLS = 1 << 14
TASK_ROWS = 100_000
#: bytes of results that the driver adds up itself
COLLECTED = 4 << 20
BLOCK_ROWS = 4000
LABEL_COLUMNS = 2048
#: sums for points and clusters that a task holds
SUMS = 1 << 24


@dataclass(frozen=True)
class Fit:
    """The best start of a setting."""

    cols: tuple[str, ...]
    k: int
    centres: list[list[float]]
    sse: float


@dataclass
class _Group:
    """Starts of one setting: positions of its columns, and centres as an array (starts, clusters, columns)."""

    at: int
    dims: np.ndarray
    starts: np.ndarray
    centres: np.ndarray


def spread_points(df: DataFrame, cols: Sequence[str], key: str) -> RDD:
    """Blocks (hashes of the key, points) as arrays, held by the executors, as every pass reads them.

    There are as many parts as cores, and more only for many points: each part returns sums for all settings.
    """
    pts = stable(df.select(F.xxhash64(key).alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols]))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-pts.count() // TASK_ROWS))
    names = list(cols)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, x = batch["_h"].to_numpy(dtype=np.int64), batch[names].to_numpy(dtype=float)
            yield pd.DataFrame({"h": [h.tobytes()], "x": [np.ascontiguousarray(x).tobytes()]})

    def unpack(row: Row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["h"], np.uint64), np.frombuffer(row["x"], float).reshape(-1, len(names))

    # one order of the rows in a part, so that sums are the same whenever it is made
    spread = pts.repartition(tasks, "_h").sortWithinPartitions("_h", *names)
    return stable(spread.mapInPandas(pack, "h binary, x binary")).rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _random(points: np.ndarray, starts: np.ndarray, round_: int) -> np.ndarray:
    """Uniform numbers in (0, 1) for each (start, point), the same however the points are divided among tasks."""
    with np.errstate(over="ignore"):
        x = points[None] ^ (starts * np.uint64(0x9E3779B97F4A7C15) + np.uint64(round_ + 1) * np.uint64(0xD1B54A32D192ED03))[:, None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the nearest cluster, the first on ties; squared distance to it), both (starts, points).

    ``x`` holds a column of the points in each row: few starts and many points make for long runs over memory.
    """
    s, k, r = centres.shape
    label, best = np.zeros((s, x.shape[1]), np.int64), np.empty((s, x.shape[1]))
    d, gap, less = np.empty_like(best), np.empty_like(best), np.empty(best.shape, bool)
    for j in range(k):
        to = best if j == 0 else d
        for c in range(r):
            own = gap if c else to
            np.subtract(x[None, c], centres[:, j, c, None], out=own)
            np.multiply(own, own, out=own)
            if c:
                np.add(to, gap, out=to)
        if j:
            np.less(d, best, out=less)
            np.copyto(label, j, where=less)
            np.minimum(best, d, out=best)
    return label, best


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_closest` for points in rows, both (points, starts)."""
    label, best = _closest(np.ascontiguousarray(x.T), centres)
    return label.T, best.T


def _combined(points: RDD, run: Callable[[Iterator], Iterator], add: Callable, size: int) -> object:
    """What ``run`` returns for each part of the points, put together by ``add``; large results meet in tasks first."""
    made = points.mapPartitions(run)
    if size * points.getNumPartitions() <= COLLECTED:
        return reduce(add, made.collect())
    return made.treeReduce(add)


def _pass(points: RDD, groups: list[_Group], work: Callable[[np.ndarray, _Group], np.ndarray], width: int) -> np.ndarray:
    """Run ``work(columns of points, group)`` on pieces of the points; its values summed, one row a cluster of each start in order."""
    shared = points.context.broadcast(groups)  # centres only: their number is that of the settings

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for h, x in blocks:
            columns = np.ascontiguousarray(x.T)
            for g in shared.value:
                step = max(1, CELLS // len(g.starts))
                own = columns[g.dims]
                for i in range(0, len(x), step):
                    part = work(own[:, i : i + step], g)
                    total[g.at] = part if g.at not in total else total[g.at] + part
        if total:
            out = np.zeros((sum(t.shape[0] * t.shape[1] for t in total.values()), width))
            at = 0
            for t in total.values():
                rows = t.reshape(-1, t.shape[2])
                out[at : at + len(rows), : rows.shape[1]] = rows
                at += len(rows)
            yield out

    sums = _combined(points, run, np.add, 8 * width * sum(len(g.starts) * g.centres.shape[1] for g in groups))
    shared.destroy()
    return sums


def _split(sums: np.ndarray, groups: list[_Group]) -> list[np.ndarray]:
    """The rows of each group as (starts, clusters, values)."""
    ends = np.cumsum([len(g.starts) * g.centres.shape[1] for g in groups])
    return [part.reshape(len(g.starts), -1, sums.shape[1]) for g, part in zip(groups, np.split(sums, ends[:-1]))]


def _first(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of two runners (waiting times, positions) the one that waits less, on ties the one at the smaller position."""
    (wa, xa), (wb, xb) = a, b
    apart = xa != xb
    at = apart.argmax(axis=1)
    rows = np.arange(len(wa))
    later = (wb < wa) | ((wb == wa) & apart.any(axis=1) & (xb[rows, at] < xa[rows, at]))
    return np.where(later, wb, wa), np.where(later[:, None], xb, xa)


def _seed(points: RDD, groups: list[_Group], ks: list[int], seed: int) -> None:
    """Fill in the centres by k-means++: a next centre is drawn with the squared distance to the ones there as weight.

    The draw is a race: each point's waiting time is exponential with its weight as rate, and the smallest one wins, so
    tasks return one runner for each start.
    """
    widest = max(len(g.dims) for g in groups)
    for t in range(max(ks)):
        open_ = [g for g, k in zip(groups, ks) if k > t]
        shared = points.context.broadcast(open_)

        def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            best = None
            for h, x in blocks:
                waits, places, columns = [], [], np.ascontiguousarray(x.T)
                for g in shared.value:
                    own, found = columns[g.dims], None
                    step = max(1, CELLS // len(g.starts))
                    for i in range(0, len(x), step):
                        part = own[:, i : i + step]
                        wait = -np.log(_random(h[i : i + step], g.starts ^ np.uint64(seed), t))
                        if t:
                            weight = _closest(part, g.centres)[1]
                            wait = np.where(weight > 0, wait / np.where(weight > 0, weight, 1), np.inf)
                        at = wait.argmin(axis=1)
                        new = wait[np.arange(len(at)), at], np.pad(part[:, at].T, ((0, 0), (0, widest - len(part))))
                        found = new if found is None else _first(found, new)
                    waits.append(found[0])
                    places.append(found[1])
                now = np.concatenate(waits), np.concatenate(places)
                best = now if best is None else _first(best, now)
            if best is not None:
                yield best

        starts = np.cumsum([len(g.starts) for g in open_])
        _, won = _combined(points, run, _first, 8 * (1 + widest) * int(starts[-1]))
        shared.destroy()
        for g, at in zip(open_, np.split(won, starts[:-1])):
            g.centres = np.concatenate([g.centres, at[:, None, : len(g.dims)]], axis=1)


def _means(x: np.ndarray, g: _Group) -> np.ndarray:
    """Size and column sums of every cluster of each start (nothing in the place of the squared distances).

    What tells squared distances to centres apart is linear in the point, so one matrix product compares all starts'
    centres, and one adds up the points that each of them has won.
    """
    s, k, r = g.centres.shape
    middle = g.centres.mean(axis=(0, 1))
    centres, y = g.centres - middle, np.concatenate([x - middle[:, None], np.ones((1, x.shape[1]))])
    weights = np.concatenate([-2 * centres, (centres * centres).sum(axis=2, keepdims=True)], axis=2)
    score = (weights.transpose(1, 0, 2).reshape(k * s, r + 1) @ y).reshape(k, s, -1)
    best = score.min(axis=0)
    out = np.zeros((s, k, 2 + r))
    for j in range(k):
        won = (score[j] == best).astype(float) @ y.T
        out[:, j, 0] = won[:, r]
        out[:, j, 2:] = won[:, :r] + won[:, r:] * middle
    tied = np.flatnonzero(out[:, :, 0].sum(axis=1) != x.shape[1])  # the first centre takes such points
    if len(tied):
        some = _Group(g.at, g.dims, g.starts[tied], g.centres[tied])
        out[tied] = _summed(x, _closest(x, some.centres)[0], some)
    return out


def _summed(x: np.ndarray, label: np.ndarray, g: _Group, more: np.ndarray | None = None) -> np.ndarray:
    """(starts, clusters, values) sums of one, ``more`` (starts, points) and the columns over the points of a cluster."""
    s, k, r = g.centres.shape
    flat = (label + (np.arange(s) * k)[:, None]).ravel()
    out = np.zeros((s * k, 2 + r))
    out[:, 0] = np.bincount(flat, minlength=s * k)
    if more is not None:
        out[:, 1] = np.bincount(flat, more.ravel(), s * k)
    for j in range(r):
        out[:, 2 + j] = np.bincount(flat, np.broadcast_to(x[j], label.shape).ravel(), s * k)
    return out.reshape(s, k, 2 + r)


def _sums(x: np.ndarray, g: _Group) -> np.ndarray:
    """Size, squared distances to the centre and column sums of every cluster of each start."""
    label, best = _closest(x, g.centres)
    return _summed(x, label, g, best)


def kmeans_many(
    df: DataFrame,
    settings: Sequence[tuple[Sequence[str], int]],
    n_init: int = 10,
    max_iter: int = 100,
    seed: int = 22,
    key: str = "customer_id",
    tolerance: float = 1e-4,
    points: RDD | None = None,
) -> list[Fit]:
    """The best of ``n_init`` k-means++ starts of every setting (columns, k), in the order given; none without points.

    A start has settled once no centre moves by more than ``tolerance``; a cluster that loses all points keeps its centre.
    ``points`` is the result of :func:`spread_points`, if it is there already.
    """
    settings = [(tuple(c), int(k)) for c, k in settings]
    cols = list(dict.fromkeys(c for own, _ in settings for c in own))
    points = spread_points(df, cols, key) if points is None else points
    if not settings or points.isEmpty():
        return []
    width = 2 + max(len(c) for c, _ in settings)
    groups = [
        _Group(
            i,
            np.array([cols.index(c) for c in own]),
            np.arange(n_init, dtype=np.uint64) + np.uint64(1) + np.uint64(i * n_init),
            np.zeros((n_init, 0, len(own))),
        )
        for i, (own, _) in enumerate(settings)
    ]
    _seed(points, groups, [k for _, k in settings], seed)
    moving = [(g, np.arange(n_init)) for g in groups]
    for _ in range(max_iter):
        if not moving:
            break
        now = [_Group(g.at, g.dims, g.starts[open_], g.centres[open_]) for g, open_ in moving]
        left = []
        # every task returns all clusters, also empty ones
        for (g, open_), part, t in zip(moving, now, _split(_pass(points, now, _means, width), now)):
            r = len(g.dims)
            n = t[..., :1]
            new = np.where(n > 0, t[..., 2 : 2 + r] / np.where(n > 0, n, 1), part.centres)
            shift = np.sqrt(((new - part.centres) ** 2).sum(axis=2)).max(axis=1)
            g.centres[open_] = new
            if (shift > tolerance).any():
                left.append((g, open_[shift > tolerance]))
        moving = left
    out = []
    for g, (own, k), t in zip(groups, settings, _split(_pass(points, groups, _sums, width), groups)):
        sse = t[..., 1].sum(axis=1)
        # starts that end in the same clusters differ in rounding only: the first of them, however sums were added
        best = int((sse <= sse.min() * (1 + 1e-9)).argmax())
        out.append(Fit(own, k, [[float(v) for v in m] for m in g.centres[best]], float(sse[best])))
    return out


# ---- scores of many labellings --------------------------------------------------------------------


def squared_silhouettes(df: DataFrame, fits: Sequence[Fit], key: str = "customer_id", points: RDD | None = None) -> list[float]:
    """Mean silhouette with squared distances of each fit's clusters, over the fit's own columns.

    The sum of squared distances to a cluster follows from its size, mean and mean square, so two passes serve all fits.
    """
    cols = list(dict.fromkeys(c for f in fits for c in f.cols))
    points = spread_points(df, cols, key) if points is None else points
    groups = [
        _Group(i, np.array([cols.index(c) for c in f.cols]), np.zeros(1, np.uint64), np.array([f.centres])) for i, f in enumerate(fits)
    ]
    width = 2 + max(len(f.cols) for f in fits)

    def moments(x: np.ndarray, g: _Group) -> np.ndarray:
        return _summed(x, _closest(x, g.centres)[0], g, (x * x).sum(axis=0)[None])

    seen = [t[0] for t in _split(_pass(points, groups, moments, width), groups)]

    def score(x: np.ndarray, g: _Group) -> np.ndarray:
        label = _closest(x, g.centres)[0][0]
        t, r, x = seen[g.at], len(x), x.T
        n = t[:, 0]
        safe = np.where(n > 0, n, 1)
        # mean squared distance to every cluster
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ (t[:, 2 : 2 + r] / safe[:, None]).T + (t[:, 1] / safe)[None]
        d = np.where(n[None] > 0, np.maximum(d, 0), np.inf)
        own = np.arange(len(x)), label
        a = d[own] * n[label] / np.maximum(n[label] - 1, 1)
        d[own] = np.inf
        b = d.min(axis=1)
        top = np.maximum(a, b)
        fine = (n[label] > 1) & (top > 0) & np.isfinite(b)
        s = np.where(fine, (b - a) / np.where(fine, top, 1), 0.0) if len(x) else np.zeros(0)
        out = np.zeros((1, g.centres.shape[1], 2))
        out[0, 0] = len(x), s.sum()
        return out

    sums = [t[0, 0] for t in _split(_pass(points, groups, score, 2), groups)]
    return [float(t[1] / t[0]) for t in sums]


def silhouettes(df: DataFrame, cols: Sequence[str], labels: str, key: str = "customer_id", block_rows: int = BLOCK_ROWS) -> list[float | None]:
    """Mean Euclidean silhouette of every labelling in the array column ``labels``; null for a single cluster.

    A task takes some of the points and passes over all of them in blocks: their distances serve all labellings, it holds
    one sum for each of its points and clusters, and returns one number a labelling. Labellings are taken together as long
    as their clusters number at most ``LABEL_COLUMNS``.
    """
    cols = list(cols)
    pts = stable(df.select(F.col(labels).cast("array<int>").alias("labels"), *[F.col(c).cast("double").alias(c) for c in cols]))
    total = pts.count()
    counts = pts.select(F.posexplode("labels").alias("l", "c")).groupBy("l", "c").agg(F.count(F.lit(1)).alias("n")).toPandas()
    sizes = {int(lab): t.sort_values("c") for lab, t in counts.groupby("l")}
    out: list[float | None] = [None] * len(sizes)
    wanted = [lab for lab, t in sizes.items() if len(t) > 1]
    while wanted:
        some, width = [], 0
        while wanted and (not some or width + len(sizes[wanted[0]]) <= LABEL_COLUMNS):
            some.append(wanted.pop(0))
            width += len(sizes[some[-1]])
        for lab, value in zip(some, _silhouettes(pts, cols, some, [sizes[lab] for lab in some], total, block_rows)):
            out[lab] = value
    return out


def _lengths(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`distances` of rows to those of ``y`` by a matrix product. Of close rows it would leave few digits, so these are
    measured by themselves."""
    middle = y.mean(axis=0)
    b = y - middle
    bb = (b * b).sum(axis=1)
    right, widest = np.concatenate([-2 * b.T, np.ones((1, len(y))), bb[None]]), bb.max()

    def run(x: np.ndarray) -> np.ndarray:
        a = x - middle
        aa = (a * a).sum(axis=1, keepdims=True)
        d = np.concatenate([a, aa, np.ones_like(aa)], axis=1) @ right
        close = d <= 1e-5 * (aa.max() + widest)
        n = np.count_nonzero(close)
        if n * 8 > d.size:
            return distances(x, y)
        if n:
            i, j = np.nonzero(close)
            gap = x[i] - y[j]
            d[i, j] = (gap * gap).sum(axis=1)
        return np.sqrt(d, out=d)

    return run


def _silhouettes(pts: DataFrame, cols: list[str], some: list[int], sizes: list[pd.DataFrame], total: int, block_rows: int) -> list[float]:
    names = [t["c"].to_numpy() for t in sizes]
    n = np.concatenate([t["n"].to_numpy(dtype=float) for t in sizes])
    first = np.cumsum([0, *[len(c) for c in names]])
    cores = pts.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(block_rows, -(-total // (2 * cores))))
    kept = F.transform(F.array(*[F.lit(i) for i in some]), lambda i: F.get("labels", i))

    def columns(labels: pd.Series) -> np.ndarray:
        """Column of each point in each labelling, over the clusters of all labellings side by side."""
        at = np.array(labels.tolist(), dtype=np.int64).reshape(len(labels), len(some))
        return np.stack([np.searchsorted(c, at[:, i]) + first[i] for i, c in enumerate(names)], axis=1)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of points; neighbours with the same labels throughout are a run, whose labels are kept once."""
        for batch in batches:
            for s in range(0, len(batch), rows):
                part = batch.iloc[s : s + rows]
                at, x = columns(part["labels"]), part[cols].to_numpy(dtype=float)
                run = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
                yield pd.DataFrame({"x": [np.ascontiguousarray(x).tobytes()], "run": [run.tobytes()], "at": [at[run].tobytes()]})

    def unpack(blocks: pd.DataFrame, suffix: str = "") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        blocks = blocks.sort_values(f"id{suffix}")
        for x, run, at in zip(*(blocks[f"{c}{suffix}"] for c in ("x", "run", "at"))):
            yield np.frombuffer(x, float).reshape(-1, len(cols)), np.frombuffer(run, np.int64), np.frombuffer(at, np.int64).reshape(-1, len(some))

    packed = pts.select(kept.alias("labels"), *cols).sort("labels").mapInPandas(pack, "x binary, run binary, at binary")
    blocks = stable(packed.withColumn("id", F.monotonically_increasing_id()))
    numbers = stable(number_rows(blocks.select("id"), ["id"], "no"))
    tasks = max(1, min(numbers.count(), max(4 * cores, -(-total * int(first[-1]) // SUMS))))
    left = blocks.join(F.broadcast(numbers), "id").withColumn("task", F.pmod("no", F.lit(tasks)).cast("int"))  # one row a block
    # renamed, so that the two sides of the same table stay apart
    right = blocks.select(*[F.col(c).alias(f"{c}2") for c in ("id", "x", "run", "at")], F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task2"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        added = np.zeros(len(some))
        mine = list(unpack(a))
        x = np.concatenate([own for own, _, _ in mine]) if mine else np.zeros((0, len(cols)))
        sums_ = np.zeros((len(x), int(first[-1])))
        for y, run, at in unpack(b, "2") if len(x) else []:
            lengths, member = _lengths(y), np.zeros((len(run), int(first[-1])))
            member[np.arange(len(run))[:, None], at] = 1
            for s in range(0, len(x), 512):
                per = np.empty((len(x[s : s + 512]), len(run)))
                for t in range(0, len(per), step := max(1, _PAIRS // len(y))):
                    np.add.reduceat(lengths(x[s : s + 512][t : t + step]), run, axis=1, out=per[t : t + step])
                sums_[s : s + 512] += per @ member
        if len(x):
            at = np.concatenate([np.repeat(at, np.diff([*run, len(own)]), axis=0) for own, run, at in mine])
            for i in range(len(some)):
                t, m = sums_[:, first[i] : first[i + 1]], n[first[i] : first[i + 1]]
                own_ = np.arange(len(t)), at[:, i] - first[i]
                size = m[own_[1]]
                inside = t[own_] / np.maximum(size - 1, 1)
                mean = t / m[None]
                mean[own_] = np.inf
                outside = mean.min(axis=1)
                top = np.maximum(inside, outside)
                fine = (size > 1) & (top > 0)
                added[i] += np.where(fine, (outside - inside) / np.where(fine, top, 1), 0.0).sum()
        return pd.DataFrame({"l": np.arange(len(some)), "s": added})

    scored = left.groupBy("task").cogroup(right.groupBy("task2")).applyInPandas(score, "l int, s double")
    found = scored.groupBy("l").agg(rnd(F.sum("s") / F.lit(float(total)), 4).alias("s")).toPandas()
    by = dict(zip(found["l"].tolist(), found["s"].tolist()))
    return [float(by[i]) for i in range(len(some))]


def davies_bouldins(points: DataFrame, cols: Sequence[str], labels: str, weight: str, block_rows: int = 2000) -> list[float | None]:
    """Davies-Bouldin score of every labelling in the array column ``labels``; null for a single cluster.

    ``weight`` says how many points a row stands for. Clusters of one labelling meet in blocks of bounded size.
    """
    cols = list(cols)
    each = points.select(F.col(weight).cast("double").alias("w"), *cols, F.posexplode(labels).alias("l", "c"))
    total = F.sum("w")
    centre = each.groupBy("l", "c").agg(*[(F.sum(F.col(x) * F.col("w")) / total).alias(f"m_{x}") for x in cols])
    gap = F.sqrt(sum(((F.col(x) - F.col(f"m_{x}")) * (F.col(x) - F.col(f"m_{x}")) for x in cols), F.lit(0.0)))
    spread = each.join(centre, ["l", "c"]).groupBy("l", "c").agg(
        (F.sum(gap * F.col("w")) / total).alias("s"), *[F.first(f"m_{x}").alias(x) for x in cols]
    )
    table = stable(spread)
    sizes = {r["l"]: r["n"] for r in table.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = max(1, -(-max(sizes.values(), default=1) // block_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    own = F.pmod(F.xxhash64("c"), F.lit(n_blocks)).cast("int")
    left = table.withColumns({"i": own, "j": every})
    right = table.select(F.col("l").alias("l2"), every.alias("i2"), own.alias("j2"), F.col("c").alias("o"), F.col("s").alias("t"), *cols)

    def worst(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(0, len(a) if len(b) else 0, 500):
            part = a.iloc[k : k + 500]
            d = distances(part[cols].to_numpy(dtype=float), b[cols].to_numpy(dtype=float))
            d[(d == 0) | (part["c"].to_numpy()[:, None] == b["o"].to_numpy()[None])] = np.inf
            ratio = (part["s"].to_numpy()[:, None] + b["t"].to_numpy()[None]) / d
            out.append(pd.DataFrame({"l": part["l"], "c": part["c"], "r": ratio.max(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"l": [], "c": [], "r": []})

    met = left.groupBy("l", "i", "j").cogroup(right.groupBy("l2", "i2", "j2")).applyInPandas(worst, "l int, c int, r double")
    scored = met.groupBy("l", "c").agg(F.max("r").alias("r")).groupBy("l").agg(rnd(F.avg("r"), 4).alias("db"))
    found = {r["l"]: float(r["db"]) for r in scored.collect()}
    return [found[i] if sizes[i] > 1 else None for i in sorted(sizes)]
