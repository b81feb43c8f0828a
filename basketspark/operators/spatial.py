"""Exact neighbourhood work over a balanced split of the points.

Points are cut into leaves of bounded size along approximate quantiles until no leaf is too large, so
a dense spot is simply cut finer. A query goes only to the leaves whose bounding box it can reach (the nearest
neighbours found in its own leaf tell how far that is), and a leaf that receives many queries is served by several tasks. Nothing emits all pairs: tasks return
the nearest few, counts, or component links. Leaf boxes are the only thing held by every task; their
number is bounded by ``MAX_LEAVES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stable

LEAF_ROWS = 1024
MAX_LEAVES = 40_000
QUERIES_PER_TASK = 20_000
#: a search for neighbours cuts its points into so many leaves, if they have ``LEAF_ROWS`` then and no more than this
KNN_LEAVES, KNN_LEAF_ROWS = 32, 1 << 17
FEW_LEAVES = 256
_FAN_OUT = 8
_BOX_CELLS = 1 << 20  # gaps between rows and boxes that are worked on at a time, over all columns
_PAIRS = 1 << 16  # distances worked on at a time, so that they stay in a core's cache
_BLOCK = 256  # points of a leaf that are passed over together
# slack so that box tests never lose a point to rounding; exact tests follow on the points
_WIDER, _NARROWER = 1 + 1e-9, 1 - 1e-9


@dataclass
class Boxes:
    """Bounding boxes of the leaves, as arrays aligned by position."""

    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def near(self, x: np.ndarray, p: int) -> np.ndarray:
        """Smallest possible distance from each row of ``x`` to each box."""

        def gap(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            out = lo - v
            return np.maximum(np.maximum(out, v - hi, out=out), 0.0, out=out)

        return self._summed(x, p, gap)

    def far(self, x: np.ndarray, p: int) -> np.ndarray:
        """Largest possible distance from each row of ``x`` to each box."""

        def gap(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            out = np.abs(v - lo)
            return np.maximum(out, np.abs(v - hi), out=out)

        return self._summed(x, p, gap)

    def _summed(self, x: np.ndarray, p: int, gap: Callable[..., np.ndarray]) -> np.ndarray:
        """Length of the gaps of each row of ``x`` and each box, one column after another."""
        total = np.zeros((len(x), len(self.lo)))
        for c in range(x.shape[1]):
            own = gap(x[:, c, None], self.lo[None, :, c], self.hi[None, :, c])
            total += own if p == 1 else np.multiply(own, own, out=own)
        return total if p == 1 else np.sqrt(total, out=total)

    def some(self, which: np.ndarray) -> Boxes:
        extra = {name: values[which] for name, values in self.extra.items()}
        return Boxes(self.leaf[which], self.lo[which], self.hi[which], self.rows[which], extra)

    def row_chunk(self) -> int:
        return max(1, _BOX_CELLS // max(1, self.lo.size))


@dataclass
class Index:
    """Points with their ``leaf`` (checkpointed) and the leaf boxes."""

    points: DataFrame
    cols: list[str]
    boxes: Boxes


def _add_columns(total: np.ndarray, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Add what the columns of ``a`` and ``b`` put to the distances, squared for ``p`` of 2, one column after another."""
    diff = np.empty_like(total)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        np.subtract(x[:, None], y[None], out=diff)
        total += np.abs(diff, out=diff) if p == 1 else np.multiply(diff, diff, out=diff)
    return total


def distances(a: np.ndarray, b: np.ndarray, p: int = 2) -> np.ndarray:
    """Distance of every row of ``a`` to every row of ``b``, summed over the columns in order."""
    total = _add_columns(np.zeros((len(a), len(b))), a, b, p)
    return total if p == 1 else np.sqrt(total, out=total)


def _blocks(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in blocks of half to all of ``rows``, cut at medians of the widest column."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            done.append(own)
            continue
        part = x[own]
        wide = (np.fmax.reduce(part) - np.fmin.reduce(part)).argmax()
        by = np.argpartition(part[:, wide], len(own) // 2)
        todo += [own[by[: len(own) // 2]], own[by[len(own) // 2 :]]]
    return done


def _pairs_within(x: np.ndarray, y: np.ndarray, limit: np.ndarray, order: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
    """(i, j, distance) of the rows of ``x`` and ``y`` that are no further apart than ``limit`` of the row of ``x``.

    Columns are taken in ``order``, as a few often tell pairs apart; the distances are those of :func:`distances`.
    """
    most = (limit * _WIDER if p == 1 else (limit * _WIDER) ** 2)[:, None]
    few = min(4, x.shape[1])
    total = _add_columns(np.zeros((len(x), len(y))), x[:, order[:few]], y[:, order[:few]], p)
    near = total <= most
    if few < x.shape[1] and np.count_nonzero(near) * 8 > near.size:
        near = _add_columns(total, x[:, order[few:]], y[:, order[few:]], p) <= most
    i, j = np.nonzero(near)
    d = np.zeros(len(i))
    for c in range(x.shape[1]):
        diff = x[i, c] - y[j, c]
        d += np.abs(diff) if p == 1 else diff * diff
    d = d if p == 1 else np.sqrt(d)
    keep = d <= limit[i]
    return i[keep], j[keep], d[keep]


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, p: int = 2, reach: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(i, j, distance): for each row of ``x`` rows of ``y`` among which are its k nearest, all that are as near as the
    k-th included; with ``reach``, those within this distance only.

    ``y`` is cut into small blocks. A row's nearest block tells how far its k-th neighbour is at most, and only blocks
    that come nearer are opened.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    blocks = _blocks(y, max(_BLOCK, 2 * k))
    points = [y[b] for b in blocks]
    boxes = Boxes(
        np.arange(len(blocks)), np.array([np.fmin.reduce(b) for b in points]), np.array([np.fmax.reduce(b) for b in points]), np.array(list(map(len, blocks)))
    )
    order = np.argsort(-np.nan_to_num(np.nanstd(y, axis=0)), kind="stable")
    step = max(1, _PAIRS // len(blocks))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        limit = np.full(len(part), np.inf) if reach is None else np.where(np.isnan(reach[s : s + step]), np.inf, reach[s : s + step])
        near = np.zeros((len(part), len(blocks)))
        for c in range(y.shape[1]):
            gap = np.maximum(boxes.lo[None, :, c] - part[:, c, None], part[:, c, None] - boxes.hi[None, :, c])
            np.maximum(gap, 0.0, out=gap)
            near += gap if p == 1 else gap * gap
        near = near if p == 1 else np.sqrt(near, out=near)
        home = np.where(np.isinf(limit), near.argmin(axis=1), -1)
        for b in np.unique(home[home >= 0]):
            own = np.flatnonzero(home == b)
            if len(blocks[b]) < k:
                continue
            for t in range(0, len(own), rows := max(1, _PAIRS // len(blocks[b]))):
                d = distances(part[own[t : t + rows]], points[b], p)
                limit[own[t : t + rows]] = np.partition(d, k - 1, axis=1)[:, k - 1]
        limit[np.isnan(limit)] = np.inf  # rows that have no distance to some points
        for b in range(len(blocks)):
            own = np.flatnonzero(near[:, b] <= limit * _WIDER)
            for t in range(0, len(own), rows := max(1, _PAIRS // len(blocks[b]))):
                some = own[t : t + rows]
                i, j, d = _pairs_within(part[some], points[b], limit[some], order, p)
                found.append((some[i] + s, blocks[b][j], d))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def box_table(points: DataFrame, cols: Sequence[str], extra: dict | None = None) -> Boxes:
    """Boxes of the current leaves; one driver row per leaf, at most ``MAX_LEAVES``."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    aggs += [expr.alias(name) for name, expr in (extra or {}).items()]
    t = points.groupBy("leaf").agg(*aggs).orderBy("leaf").toPandas()
    return Boxes(
        t["leaf"].to_numpy(),
        t[[f"_lo_{c}" for c in cols]].to_numpy(dtype=float).reshape(len(t), len(cols)),
        t[[f"_hi_{c}" for c in cols]].to_numpy(dtype=float).reshape(len(t), len(cols)),
        t["_rows"].to_numpy(),
        {name: t[name].to_numpy() for name in (extra or {})},
    )


def build_index(points: DataFrame, cols: Sequence[str], leaf_rows: int | None = None, leaves: int | None = None) -> Index:
    """Split points into leaves of at most twice ``leaf_rows``; with ``leaves``, into larger ones of up to about
    ``KNN_LEAF_ROWS`` if that many leaves are enough.

    Copies of one position cannot be separated, so callers keep only a bounded number of them.
    """
    cols = list(cols)
    spark = points.sparkSession
    cur = stable(points.withColumn("leaf", F.lit(0).cast("long")))
    boxes = box_table(cur, cols)
    total = int(boxes.rows.sum())
    target = max(leaf_rows or LEAF_ROWS, -(-total * _FAN_OUT // MAX_LEAVES))
    if leaves:
        target = max(target, min(total // leaves, KNN_LEAF_ROWS))
    next_leaf = 1
    while True:
        width = boxes.hi - boxes.lo
        large = (boxes.rows > 2 * target) & (width.max(axis=1) > 0) if total else np.array([], dtype=bool)
        if not large.any():
            return Index(cur, cols, boxes)
        dims = width.argmax(axis=1)
        pick = pd.DataFrame({"leaf": boxes.leaf[large], "dim": dims[large].astype("int64")})
        chosen = F.array(*cols)[F.col("dim").cast("int")]
        shares = [i / _FAN_OUT for i in range(1, _FAN_OUT)]
        edges = (
            cur.join(F.broadcast(spark.createDataFrame(pick)), "leaf")
            .groupBy("leaf")
            .agg(F.percentile_approx(chosen, shares, 1000).alias("edges"))
            .toPandas()
            .set_index("leaf")["edges"]
        )
        plan = []
        for i in np.flatnonzero(large):
            d, leaf = int(dims[i]), int(boxes.leaf[i])
            inner = sorted({float(e) for e in edges[leaf] if e < boxes.hi[i, d]})
            inner = inner or [float((boxes.lo[i, d] + boxes.hi[i, d]) / 2)]
            plan.append((leaf, d, inner, next_leaf))
            next_leaf += len(inner) + 1
        splits = spark.createDataFrame(plan, "leaf long, dim int, edges array<double>, base long")
        below = F.size(F.filter("edges", lambda e: e < F.col("_x")))
        cur = stable(
            cur.join(F.broadcast(splits), "leaf", "left")
            .withColumn("_x", F.array(*cols)[F.col("dim")])
            .withColumn("leaf", F.when(F.col("base").isNull(), F.col("leaf")).otherwise(F.col("base") + below))
            .drop("dim", "edges", "base", "_x")
        )
        boxes = box_table(cur, cols)


def route(
    queries: DataFrame,
    cols: Sequence[str],
    boxes: Boxes,
    p: int = 2,
    *,
    radius: float | str | None = None,
    k: int | None = None,
    home: bool = False,
) -> DataFrame:
    """Repeat each query for every leaf it has to visit, as column ``to_leaf``.

    ``radius``, a number or the column that holds a query's own, visits the boxes within it. ``home`` visits the nearest box only. ``k`` is for queries that have been
    home: they carry ``_home``, which is not visited again, and the distance ``_reach`` of their k-th neighbour there;
    where that is null, the boxes that surely hold k points bound it.
    """
    cols = list(cols)
    schema = T.StructType([*queries.schema.fields, T.StructField("to_leaf", T.LongType())])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), boxes.row_chunk()):
                part = batch.iloc[start : start + boxes.row_chunk()]
                x = part[cols].to_numpy(dtype=float)
                near = boxes.near(x, p)
                if radius is not None:
                    go = near <= (part[radius].to_numpy(dtype=float)[:, None] if isinstance(radius, str) else radius) * _WIDER
                elif home:
                    go = np.zeros(near.shape, dtype=bool)
                    if go.size:
                        go[np.arange(len(x)), near.argmin(axis=1)] = True
                else:
                    reach = part["_reach"].to_numpy(dtype=float).copy()
                    short = np.flatnonzero(np.isnan(reach))
                    reach[short] = _filled(boxes, x[short], p, k)
                    go = near <= reach[:, None] * _WIDER
                    go &= boxes.leaf[None] != part["_home"].to_numpy()[:, None]
                qi, bi = np.nonzero(go)
                out = part.iloc[qi].copy()
                out["to_leaf"] = boxes.leaf[bi]
                yield out

    return queries.mapInPandas(visit, schema)


def _filled(boxes: Boxes, x: np.ndarray, p: int, k: int) -> np.ndarray:
    """A distance within which each row of ``x`` surely has k points, or all there are."""
    far = boxes.far(x, p)
    if not far.size:
        return np.full(len(x), np.inf)
    order = far.argsort(axis=1)
    filled = boxes.rows[order].cumsum(axis=1) >= k
    at = np.where(filled.any(axis=1), filled.argmax(axis=1), far.shape[1] - 1)
    return np.take_along_axis(far, order, 1)[np.arange(len(x)), at]


def meet(
    routed: DataFrame,
    index_points: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Call ``fn(queries, leaf points)`` per leaf; busy leaves are copied to several tasks.

    Routes are read twice, so they are written; those of queries that have been home only where :func:`knn` does it."""
    routed = routed if "_home" in routed.columns else stable(routed)
    load = routed.groupBy("to_leaf").agg(
        F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("_parts")
    )
    load = F.broadcast(stable(load))  # one row per leaf
    asked = routed.join(load, "to_leaf").withColumn(
        "_part", F.pmod(F.xxhash64(*routed.columns), F.col("_parts")).cast("int")
    )
    served = index_points.withColumnRenamed("leaf", "to_leaf").join(load, "to_leaf").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    )

    def one(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        return fn(q, pts)

    left = asked.drop("_parts").groupBy("to_leaf", "_part")
    right = served.drop("_parts").groupBy("to_leaf", "_part")
    return left.cogroup(right).applyInPandas(one, schema)


def few_copies(points: DataFrame, cols: Sequence[str], key: str, k: int) -> DataFrame:
    """The ``k`` smallest keys of each position: further copies can never be among k nearest."""
    w = Window.partitionBy(*cols).orderBy(key)
    return points.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= k).drop("_copy")


def knn(
    queries: DataFrame,
    points: DataFrame,
    cols: Sequence[str],
    k: int,
    *,
    query_key: str = "query_id",
    key: str = "point_id",
    p: int = 2,
    leaf_rows: int | None = None,
) -> DataFrame:
    """(query_key, rank, key, dist): the k nearest points, ties by smaller key. Exact.

    A query (one row per key) first searches the leaf it lies in; the k-th distance found there is the radius within
    which other leaves are visited. In few dimensions these are a handful. With a dozen, most leaves lie within the
    radius of most queries however they are cut. Leaves are therefore large, so that a query is sent to few of them, and
    :func:`nearest_rows` looks inside; a visit returns only what lies within the radius.
    """
    cols = list(cols)
    pts = few_copies(points.select(key, *cols), cols, key, k)
    index = build_index(pts, cols, max(leaf_rows or LEAF_ROWS, k), None if leaf_rows else KNN_LEAVES)
    types = dict(queries.dtypes)[query_key], dict(points.dtypes)[key]

    def nearest(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        out = []
        px, ids = pts[cols].to_numpy(dtype=float), pts[key].to_numpy()
        for s in range(0, len(q) if len(px) else 0, 2048):
            part = q.iloc[s : s + 2048]
            reach = part["_reach"].to_numpy(dtype=float) if "_reach" in part else None
            qi, pi, dist = nearest_rows(part[cols].to_numpy(dtype=float), px, k, p, reach)
            near = pd.DataFrame({"qi": qi, key: ids[pi], "dist": dist}).sort_values(["qi", "dist", key])
            near = near[near.groupby("qi").cumcount() < k]
            near[query_key] = part[query_key].to_numpy()[near["qi"]]
            out.append(near[[query_key, key, "dist"]])
        return pd.concat(out) if out else pd.DataFrame({query_key: [], key: [], "dist": []})

    schema = f"{query_key} {types[0]}, {key} {types[1]}, dist double"
    home = stable(route(queries.select(query_key, *cols), cols, index.boxes, p, home=True))
    found = stable(meet(home, index.points, nearest, schema))
    reach = found.groupBy(query_key).agg(F.count(F.lit(1)).alias("_n"), F.max("dist").alias("_reach"))
    reach = reach.where(F.col("_n") == k).drop("_n")
    if len(index.boxes.leaf) > 1:
        rest = home.withColumnRenamed("to_leaf", "_home").join(reach, query_key, "left")
        # with few leaves a query goes to many of them and routes are soon found again, so they are not written
        few = len(index.boxes.leaf) <= FEW_LEAVES
        away = route(stable(rest) if few else rest, cols, index.boxes, p, k=k)
        found = found.unionByName(meet(away if few else stable(away), index.points, nearest, schema))
    w = Window.partitionBy(query_key).orderBy("dist", key)
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(query_key, "rank", key, "dist")
    )
