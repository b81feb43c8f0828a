"""Density clusters, single linkage and reachability over one spatial index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import number_rows, stable
from ..graph import connected_components
from .batched import davies_bouldins, silhouettes
from .forest import joined
from .metrics import silhouette
from ..spatial import (
    _NARROWER,
    _PAIRS,
    _WIDER,
    Boxes,
    Index,
    box_table,
    build_index,
    distances,
    knn,
    meet,
    nearest_rows,
    route,
)


#: points of a leaf that are compared with those of others before all are, besides the outermost ones
_PICKED = 8


def _chunks(q: pd.DataFrame, n_points: int) -> Iterator[pd.DataFrame]:
    step = max(1, _PAIRS // max(1, n_points))
    for s in range(0, len(q), step):
        yield q.iloc[s : s + step]


def position_index(df: DataFrame, cols: Sequence[str], key: str, leaf_rows: int | None = None) -> Index:
    """Index over the distinct positions: smallest key ``pid`` and number of copies ``w`` of each."""
    pts = df.select(F.col(key).alias("pid"), *[F.col(c).cast("double").alias(c) for c in cols])
    return build_index(pts.groupBy(*cols).agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w")), cols, leaf_rows)


def degrees(index: Index, eps: float, enough: int | None = None) -> DataFrame:
    """(pid, degree): points within eps of each position, itself and copies included.

    A box that lies wholly within reach adds its total without being opened, first those within reach of a whole leaf.
    With ``enough`` a position's counting ends once it has that many, so a degree that is not below it may be too small;
    boxes beside its own leaf are then opened only for positions that still lack some.
    """
    cols = index.cols
    boxes = box_table(index.points, cols, {"weight": F.sum("w")})
    need = np.inf if enough is None else enough
    schema = "pid long, " + ", ".join(f"{c} double" for c in cols) + ", to_leaf long, degree long"

    def visit(key: tuple, pts: pd.DataFrame) -> pd.DataFrame:
        x, w = pts[cols].to_numpy(dtype=float), pts["w"].to_numpy()
        near, whole = _reached(boxes, np.fmin.reduce(x), np.fmax.reduce(x), eps)
        degree = np.full(len(x), boxes.extra["weight"][whole].sum(), dtype="int64")
        beside = boxes.some(near & ~whole)
        todo, out = np.flatnonzero(degree < need), []
        for r in range(0, len(todo), beside.row_chunk()):
            rows = todo[r : r + beside.row_chunk()]
            sure = beside.far(x[rows], 2) <= eps * _NARROWER
            open_ = (beside.near(x[rows], 2) <= eps * _WIDER) & ~sure
            degree[rows] += (sure * beside.extra["weight"][None]).sum(axis=1)
            home = beside.leaf == key[0]
            own = rows[open_[:, home].any(axis=1) & (degree[rows] < need)]
            for s in range(0, len(own), step := max(1, _PAIRS // len(x))):
                some = own[s : s + step]
                degree[some] += ((distances(x[some], x) <= eps) * w[None]).sum(axis=1)
            qi, bi = np.nonzero(open_ & ~home[None] & (degree[rows] < need)[:, None])
            out.append(pts.iloc[rows[qi]][["pid", *cols]].assign(to_leaf=beside.leaf[bi], degree=0))
        return pd.concat([pts[["pid", *cols]].assign(to_leaf=-1, degree=degree), *out])

    def count(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        px, w = pts[cols].to_numpy(dtype=float), pts["w"].to_numpy()
        out = []
        for part in _chunks(q, len(px)):
            d = distances(part[cols].to_numpy(dtype=float), px)
            out.append(pd.DataFrame({"pid": part["pid"], "degree": ((d <= eps) * w[None]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "degree": []})

    visited = stable(index.points.select("leaf", "pid", "w", *cols).groupBy("leaf").applyInPandas(visit, schema))
    opened = meet(visited.where("to_leaf >= 0").drop("degree"), index.points, count, "pid long, degree long")
    sure = visited.where("to_leaf < 0").select("pid", "degree")
    return sure.unionByName(opened).groupBy("pid").agg(F.sum("degree").alias("degree"))


def _reached(boxes: Boxes, lo: np.ndarray, hi: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(boxes that a point of the box ``lo`` to ``hi`` may reach, boxes that every point of it reaches wholly)."""
    gap = np.maximum(np.maximum(boxes.lo - hi, lo - boxes.hi), 0.0)
    span = np.maximum(boxes.hi, hi) - np.minimum(boxes.lo, lo)
    return np.sqrt((gap * gap).sum(axis=1)) <= eps * _WIDER, np.sqrt((span * span).sum(axis=1)) <= eps * _NARROWER


def _leaf_components(eps: float, cols: list[str]):
    def run(pts: pd.DataFrame) -> pd.DataFrame:
        pts = pts.sort_values("pid")
        x, ids = pts[cols].to_numpy(dtype=float), pts["pid"].to_numpy()
        comp = np.full(len(x), -1, dtype="int64")
        for seed in range(len(x)):
            if comp[seed] >= 0:
                continue
            comp[seed] = ids[seed]
            frontier = np.array([seed])
            while len(frontier):
                rest = np.flatnonzero(comp < 0)
                if not len(rest):
                    break
                hit = np.zeros(len(rest), dtype=bool)
                for s in range(0, len(frontier), 512):
                    hit |= (distances(x[frontier[s : s + 512]], x[rest]) <= eps).any(axis=0)
                frontier = rest[hit]
                comp[frontier] = ids[seed]
        # the outermost points in every direction, and some between them
        picked = np.zeros(len(x), dtype=bool)
        picked[np.concatenate([x.argmin(axis=0), x.argmax(axis=0), np.linspace(0, len(x) - 1, _PICKED, dtype=int)])] = True
        return pts.assign(comp=comp, picked=picked)

    return run


def _sure_links(local: DataFrame, cols: list[str], boxes: Boxes, eps: float) -> DataFrame:
    """(u, v): links between components of different leaves that the leaves' boxes or their picked points show.

    Only links that a task's others do not make up for are returned, fewer than there are components of picked points.
    """
    spark = local.sparkSession
    seen = local.where("picked").select("leaf", "comp", *cols).orderBy("leaf", "comp", *cols).toPandas()
    x, (names, comp) = seen[cols].to_numpy(dtype=float), np.unique(seen["comp"].to_numpy(), return_inverse=True)
    at = np.searchsorted(seen["leaf"].to_numpy(), [*boxes.leaf, boxes.leaf[-1] + 1])
    shared = spark.sparkContext.broadcast((boxes, x, comp, names, at))  # a few points a leaf

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes, x, comp, names, at = shared.value
        root = np.arange(len(names))
        for batch in batches:
            for i in batch["i"]:
                near, whole = _reached(boxes, boxes.lo[i], boxes.hi[i], eps)
                # every point pair of such leaves is within eps, so each leaf is one component
                found = [np.stack([np.full(n := np.count_nonzero(whole), comp[at[i]]), comp[at[:-1][whole]]], axis=1)] if len(x) else []
                own = np.arange(at[i], at[i + 1])
                others = np.flatnonzero(np.repeat(near & ~whole, np.diff(at)))
                for s in range(0, len(others), 4096):
                    part = others[s : s + 4096]
                    a, b = np.nonzero((distances(x[own], x[part]) <= eps) & (root[comp[own]][:, None] != root[comp[part]][None]))
                    found.append(np.unique(np.stack([comp[own[a]], comp[part[b]]], axis=1), axis=0))
                links = np.concatenate(found)
                root = joined(np.concatenate([links, np.stack([np.arange(len(root)), root], axis=1)]), len(root)) if (
                    root[links[:, 0]] != root[links[:, 1]]
                ).any() else root
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"u": names[moved], "v": names[root[moved]]})

    tasks = max(1, min(len(boxes.leaf), spark.sparkContext.defaultParallelism))
    numbers = spark.range(0, len(boxes.leaf), 1, tasks).withColumnRenamed("id", "i")
    return numbers.mapInPandas(visit, "u long, v long")


def _touching_leaves(spark, boxes: Boxes, eps: float) -> DataFrame:
    """(a, b): leaf pairs a < b within eps that are not known to be of one and the same component."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = boxes.extra["low"], boxes.extra["high"]
        for batch in batches:
            for i in batch["i"]:
                near, _ = _reached(boxes, boxes.lo[i], boxes.hi[i], eps)
                near &= (boxes.leaf > boxes.leaf[i]) & ((low != low[i]) | (high != high[i]) | (low != high))
                yield pd.DataFrame({"a": boxes.leaf[i], "b": boxes.leaf[near]})

    return spark.range(len(boxes.leaf)).withColumnRenamed("id", "i").mapInPandas(visit, "a long, b long")


def eps_components(points: DataFrame, cols: Sequence[str], eps: float) -> DataFrame:
    """Add ``root``, the smallest pid connected through steps of at most eps.

    ``points`` carry pid and leaf. Leaves are solved on their own and joined by what a few points of each show; then
    only points that are not yet of the same component as all of a neighbouring leaf are compared with its points.
    """
    cols = list(cols)
    spark = points.sparkSession
    local_schema = T.StructType(
        [*points.schema.fields, T.StructField("comp", T.LongType()), T.StructField("picked", T.BooleanType())]
    )
    local = stable(points.groupBy("leaf").applyInPandas(_leaf_components(eps, cols), local_schema))
    boxes = box_table(local, cols)
    if len(boxes.leaf) < 2:
        return local.drop("picked").withColumnRenamed("comp", "root")

    def named(points: DataFrame, links: DataFrame) -> DataFrame:
        """``points`` with the smallest connected component in the place of their own."""
        roots = connected_components(points.select(F.col("comp").alias("v")).distinct(), links)
        return points.join(roots.withColumnRenamed("v", "comp"), "comp").drop("comp").withColumnRenamed("root", "comp")

    local = stable(named(local, _sure_links(local, cols, boxes, eps)).drop("picked"))
    boxes = box_table(local, cols, {"low": F.min("comp"), "high": F.max("comp")})
    split = stable(_touching_leaves(spark, boxes, eps))
    edge = ["leaf", "only", *[f"lo_{c}" for c in cols], *[f"hi_{c}" for c in cols]]
    only = [int(a) if a == b else None for a, b in zip(boxes.extra["low"], boxes.extra["high"])]
    kinds = ", ".join(f"{c} {'long' if i < 2 else 'double'}" for i, c in enumerate(edge))
    boxed = spark.createDataFrame(
        [(int(leaf), only[i], *map(float, boxes.lo[i]), *map(float, boxes.hi[i])) for i, leaf in enumerate(boxes.leaf)], kinds
    )
    gaps = [F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in cols]
    reach = sum((g * g for g in gaps), F.lit(0.0)) <= (eps * _WIDER) ** 2

    def side(own: str, other: str) -> DataFrame:
        """Points of one leaf that can reach the other leaf's box, and are not of the one component there."""
        return (
            local.select(F.col("leaf").alias(own), "comp", *cols)
            .join(split, own)
            .join(F.broadcast(boxed.withColumnRenamed("leaf", other)), other)
            .where(reach & ~F.col("comp").eqNullSafe(F.col("only")))
            .select("a", "b", "comp", *cols)
        )

    def touch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links: set[tuple[int, int]] = set()
        rx, rc = right[[f"{c}2" for c in cols]].to_numpy(dtype=float), right["comp2"].to_numpy()
        for part in _chunks(left, len(rx)):
            if not len(rx):
                break
            i, j = np.nonzero(distances(part[cols].to_numpy(dtype=float), rx) <= eps)
            found = np.unique(np.stack([part["comp"].to_numpy()[i], rc[j]]), axis=1)
            links.update(zip(found[0].tolist(), found[1].tolist()))
        return pd.DataFrame(sorted(links), columns=["u", "v"], dtype="int64")

    # renamed, so that the two sides of the same table stay apart
    far = side("b", "a").select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("comp").alias("comp2"), *[
        F.col(c).alias(f"{c}2") for c in cols
    ])
    links = side("a", "b").groupBy("a", "b").cogroup(far.groupBy("a2", "b2")).applyInPandas(touch, "u long, v long")
    return named(local, links).withColumnRenamed("comp", "root")


def _number_clusters(roots: DataFrame) -> DataFrame:
    """Clusters in order of their smallest key, starting at 0."""
    return number_rows(roots.select("root").distinct(), ["root"], "cluster")


def counted_positions(index: Index, eps: float, enough: int | None = None) -> DataFrame:
    """The index's positions with ``degree``, written out."""
    return stable(index.points.join(degrees(index, eps, enough), "pid"))


def dbscan(
    df: DataFrame,
    cols: Sequence[str],
    eps: float,
    min_pts: int,
    key: str = "customer_id",
    index: Index | None = None,
    leaf_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(key, cluster): a point with ``min_pts`` points within eps (itself included) is core; -1 is noise.

    A border point joins the earliest cluster that reaches it. ``counted`` is the result of
    :func:`counted_positions` for ``index`` and ``eps``, if it is there already.
    """
    cols = list(cols)
    index = index or position_index(df, cols, key, leaf_rows)
    deg = counted_positions(index, eps, min_pts) if counted is None else counted
    core = eps_components(deg.where(F.col("degree") >= min_pts), cols, eps)
    core = stable(core.select("pid", *cols, "leaf", "root"))
    rest = deg.where(F.col("degree") < min_pts).select("pid", *cols)

    def adopt(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        px, root = pts[cols].to_numpy(dtype=float), pts["root"].to_numpy()
        out = []
        for part in _chunks(q, len(px)):
            if not len(px):
                break
            near = distances(part[cols].to_numpy(dtype=float), px) <= eps
            best = np.where(near, root[None], np.iinfo("int64").max).min(axis=1)
            out.append(pd.DataFrame({"pid": part["pid"], "root": best})[near.any(axis=1)])
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "root": []})

    boxes = box_table(core, cols)
    if len(boxes.leaf):
        border = meet(route(rest, cols, boxes, radius=eps), core, adopt, "pid long, root long")
        border = border.groupBy("pid").agg(F.min("root").alias("root"))
        found = core.select("pid", "root").unionByName(border)
    else:
        found = core.select("pid", "root")
    named = found.join(_number_clusters(core), "root").select("pid", "cluster")
    labels = index.points.join(named, "pid", "left").select(*cols, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    data = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return data.join(labels, cols).select(key, "cluster")


def single_linkage(
    df: DataFrame,
    cols: Sequence[str],
    height: float,
    key: str = "customer_id",
    index: Index | None = None,
    leaf_rows: int | None = None,
) -> DataFrame:
    """(key, cluster): the single-linkage tree cut at ``height``."""
    cols = list(cols)
    index = index or position_index(df, cols, key, leaf_rows)
    found = eps_components(index.points.select("pid", *cols, "leaf"), cols, height)
    labels = found.join(_number_clusters(found), "root").select(*cols, "cluster")
    data = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return data.join(labels, cols).select(key, "cluster")


def k_distance(
    df: DataFrame, cols: Sequence[str], k: int = 4, key: str = "customer_id", leaf_rows: int | None = None
) -> DataFrame:
    """(key, dist): distance to the k-th nearest other point, ascending."""
    cols = list(cols)
    pts = df.select(F.col(key).alias("point_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    spots = pts.groupBy(*cols).agg(F.min("point_id").alias("query_id"))
    # the point itself is the nearest, so rank k + 1 is the k-th other
    far = knn(spots, pts, cols, k + 1, leaf_rows=leaf_rows).where(F.col("rank") == k + 1)
    at = spots.join(far.select("query_id", "dist"), "query_id").drop("query_id")
    return pts.join(at, cols).select(F.col("point_id").alias(key), "dist").orderBy("dist", key)


def optics(
    df: DataFrame,
    cols: Sequence[str],
    radius: float = 0.08,
    neighbors: int = 4,
    key: str = "customer_id",
    leaf_rows: int | None = None,
) -> DataFrame:
    """(key, cluster, core_dist, reachability) without the sequential ordering walk.

    ``core_dist`` is the distance to the ``neighbors``-th other point if within ``radius``;
    ``reachability`` the smallest max(core distance of q, distance to q) over core points q in reach.
    """
    cols = list(cols)
    index = position_index(df, cols, key, leaf_rows)
    pts = df.select(F.col(key).alias("point_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    spots = index.points.select(F.col("pid").alias("query_id"), *cols)
    near = stable(knn(spots, pts, cols, neighbors + 1, leaf_rows=leaf_rows))
    kth = near.where((F.col("rank") == neighbors + 1) & (F.col("dist") <= radius))
    cores = stable(
        index.points.join(kth.select(F.col("query_id").alias("pid"), F.col("dist").alias("core_dist")), "pid")
    )

    # no point farther away than the value that the nearest neighbours give can lower it
    held = pts.join(cores.select(F.col("pid").alias("core"), "core_dist", "w", *cols), cols).select("point_id", "core", "core_dist", "w")
    sure = near.join(held, "point_id").where((F.col("core") != F.col("query_id")) | (F.col("w") > 1)).where(F.col("dist") <= radius)
    sure = sure.groupBy(F.col("query_id").alias("pid")).agg(F.min(F.greatest("dist", "core_dist")).alias("_within"))
    asked = index.points.select("pid", *cols).join(sure, "pid", "left")
    asked = stable(asked.withColumn("_within", F.coalesce("_within", F.lit(float(radius)))))

    def reach(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        px, cd, ids, w = (p[cols].to_numpy(dtype=float), *(p[c].to_numpy() for c in ("core_dist", "pid", "w")))
        out = []
        for s in range(0, len(q) if len(px) else 0, 2048):
            part = q.iloc[s : s + 2048]
            own = part["pid"].to_numpy()
            i, j, d = nearest_rows(part[cols].to_numpy(dtype=float), px, 1, reach=part["_within"].to_numpy(dtype=float))
            other = (own[i] != ids[j]) | (w[j] > 1)
            out.append(pd.DataFrame({"pid": own[i], "reachability": np.maximum(d, cd[j])})[other].groupby("pid", as_index=False).min())
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "reachability": []})

    boxes = box_table(cores, cols)
    labels = dbscan(df, cols, radius, neighbors + 1, key, index=index)
    at = index.points.select("pid", *cols).join(cores.select("pid", "core_dist"), "pid", "left")
    if len(boxes.leaf):
        met = meet(route(asked, cols, boxes, radius="_within"), cores, reach, "pid long, reachability double")
        at = at.join(met.groupBy("pid").agg(F.min("reachability").alias("reachability")), "pid", "left")
    else:
        at = at.withColumn("reachability", F.lit(None).cast("double"))
    data = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return data.join(at.drop("pid"), cols).join(labels, key).select(key, "cluster", "core_dist", "reachability")


def _reachability_trees(points: DataFrame, cols: list[str], reach: float, n_trees: int) -> DataFrame:
    """(m, a, b, w): for each of the core distances in ``cd``, the spanning forest of mutual reachability up to ``reach``.

    Two points are as far apart as their distance or the larger of their core distances. All trees grow in the same
    rounds: every component takes its nearest link to another one (ties by the smaller ids), and a pair of points is
    measured once for all trees. ``points`` has no, cd, leaf and the columns.
    """
    comp = [F.when(F.get("cd", F.lit(m)) <= reach, F.col("no")) for m in range(n_trees)]
    points = stable(points.select("no", "leaf", *cols, "cd", F.array(*comp).alias("comp")))
    forest = None

    def closest(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        px, ids = pts[cols].to_numpy(dtype=float), pts["no"].to_numpy()
        pcd = np.array(pts["cd"].tolist(), dtype=float).reshape(len(pts), -1)
        pcomp = np.array([[-1 if v is None or v != v else v for v in c] for c in pts["comp"]], dtype="int64").reshape(len(pts), -1)
        out = []
        for part in _chunks(q, len(px)):
            if not len(px):
                break
            d = distances(part[cols].to_numpy(dtype=float), px)
            own = part["no"].to_numpy()
            cd = np.array(part["cd"].tolist(), dtype=float).reshape(len(part), -1)
            own_comp = np.array([[-1 if v is None or v != v else v for v in c] for c in part["comp"]], dtype="int64").reshape(len(part), -1)
            for m in range(n_trees):
                w = np.maximum(d, np.maximum(cd[:, m, None], pcd[None, :, m]))
                w[(own_comp[:, m, None] == pcomp[None, :, m]) | (w > reach)] = np.inf
                low = w.min(axis=1)
                j = np.where(w == low[:, None], ids[None], np.iinfo("int64").max).argmin(axis=1)
                found = np.isfinite(low)
                out.append(
                    pd.DataFrame(
                        {"m": m, "c": own_comp[:, m], "w": low, "a": np.minimum(own, ids[j]), "b": np.maximum(own, ids[j]), "o": pcomp[j, m]}
                    )[found]
                )
        if not out:
            return pd.DataFrame({c: [] for c in ("m", "c", "w", "a", "b", "o")})
        # one link a component is enough of a leaf
        return pd.concat(out).sort_values(["m", "c", "w", "a", "b"]).drop_duplicates(["m", "c"])

    while True:
        boxes = box_table(points, cols)
        active = points.where(F.exists("comp", lambda c: c.isNotNull()))
        met = meet(route(active, cols, boxes, radius=reach), points, closest, "m int, c long, w double, a long, b long, o long")
        best = stable(met.groupBy("m", "c").agg(F.min(F.struct("w", "a", "b", "o")).alias("e")).select("m", "c", "e.*"))
        if best.isEmpty():
            return forest
        links = best.select("m", "a", "b", "w").distinct()
        forest = links if forest is None else forest.unionByName(links)
        name = F.col("m").cast("long") * (1 << 40)
        roots = connected_components(
            best.select((name + F.col("c")).alias("v")).unionByName(best.select((name + F.col("o")).alias("v"))).distinct(),
            best.select((name + F.col("c")).alias("u"), (name + F.col("o")).alias("v")),
        )
        moved = roots.select(
            F.shiftright("v", 40).cast("int").alias("m"), F.col("v").bitwiseAND((1 << 40) - 1).alias("c"), F.col("root").bitwiseAND((1 << 40) - 1).alias("to")
        )
        each = points.select("no", F.posexplode("comp").alias("m", "c")).join(moved, ["m", "c"], "left")
        comps = each.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("m", F.coalesce("to", "c").alias("c")))).alias("t"))
        points = stable(points.drop("comp").join(comps.select("no", F.col("t.c").alias("comp")), "no"))


def dbscan_labels(
    df: DataFrame, cols: Sequence[str], settings: Sequence[tuple[float, int]], key: str = "customer_id", leaf_rows: int | None = None
) -> DataFrame:
    """(columns, w, labels): the clusters of all distinct positions under all ``settings`` (eps, min_pts); -1 is noise.

    The labels are those of :func:`dbscan`, named by position numbers. A point's core distance says from which eps on it
    is core, the spanning forest of mutual reachability holds the clusters of every eps, and a border point has fewer
    than ``min_pts`` points in reach, so its nearest neighbours are all the core points that can claim it.
    """
    cols = list(cols)
    mins = sorted({int(m) for _, m in settings})
    reach = float(max(e for e, _ in settings))
    index = position_index(df, cols, key, leaf_rows)
    spots = stable(number_rows(index.points, ["pid"], "no"))
    pts = df.select(F.col(key).alias("point_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    near = stable(knn(spots.select(F.col("no").alias("query_id"), *cols), pts, cols, max(mins), leaf_rows=leaf_rows))
    dist = [F.max(F.when(F.col("rank") == m, F.col("dist"))) for m in mins]
    far = F.lit(float("inf"))
    cds = near.groupBy(F.col("query_id").alias("no")).agg(F.array(*[F.coalesce(d, far) for d in dist]).alias("cd"))
    points = stable(spots.join(cds, "no"))
    forest = _reachability_trees(points.select("no", "leaf", *cols, "cd"), cols, reach, len(mins))

    spark = df.sparkSession
    grid = spark.createDataFrame([(s, float(e), mins.index(int(m))) for s, (e, m) in enumerate(settings)], "s int, eps double, m int")
    grid = F.broadcast(grid)  # one row a setting
    name = F.col("s").cast("long") * (1 << 40)
    cores = points.select("no", F.posexplode("cd").alias("m", "cd")).join(grid, "m").where("cd <= eps")
    vertices = cores.select((name + F.col("no")).alias("v"))
    if forest is None:
        roots = vertices.select("v", F.col("v").alias("root"))
    else:
        edges = forest.join(grid, "m").where("w <= eps").select((name + F.col("a")).alias("u"), (name + F.col("b")).alias("v"))
        roots = connected_components(vertices, edges)
    low = (1 << 40) - 1
    core = stable(
        roots.select(F.shiftright("v", 40).cast("int").alias("s"), F.col("v").bitwiseAND(low).alias("no"), F.col("root").bitwiseAND(low).alias("c"))
    )
    # a claim holds while the neighbour is core and in reach, and the point itself is not core
    who = near.join(pts.join(points.select("no", *cols), cols).select("point_id", F.col("no").alias("q")), "point_id")
    claims = who.select(F.col("query_id").alias("no"), "q", "rank", "dist").join(points.select("no", "cd"), "no")
    claims = claims.select("no", "q", "rank", "dist", F.posexplode("cd").alias("m", "cd")).join(grid, "m")
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(mins)), "m int, min_pts int"))
    claims = claims.join(sizes, "m").where("rank < min_pts and dist <= eps and eps < cd").select("s", "no", "q")
    border = claims.join(core.withColumnRenamed("no", "q"), ["s", "q"]).groupBy("s", "no").agg(F.min("c").alias("c"))
    named = core.unionByName(border).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("by"))
    order = F.sequence(F.lit(0), F.lit(len(settings) - 1))
    labels = F.transform(order, lambda s: F.coalesce(F.try_element_at("by", s), F.lit(-1).cast("long")).cast("int"))
    empty = F.array_repeat(F.lit(-1), len(settings))
    out = points.join(named, "no", "left").select(*cols, "w", F.when(F.col("by").isNull(), empty).otherwise(labels).alias("labels"))
    return stable(out)


def dbscan_grid(
    df: DataFrame,
    cols: Sequence[str],
    eps_values: Sequence[float],
    min_pts_values: Sequence[int],
    key: str = "customer_id",
    mode: str = "exact",
    leaf_rows: int | None = None,
) -> DataFrame:
    """(eps, min_pts, n_clusters, n_noise, davies_bouldin, silhouette) per setting, all from the same few passes.

    Noise counts as a cluster in both scores; with one cluster there are none.
    """
    cols = list(cols)
    settings = [(float(e), int(m)) for e in eps_values for m in min_pts_values]
    labels = dbscan_labels(df, cols, settings, key, leaf_rows)
    each = labels.select("w", F.posexplode("labels").alias("s", "c")).groupBy("s", "c").agg(F.sum("w").alias("n"))
    counts = each.groupBy("s").agg(F.count_if(F.col("c") >= 0).alias("k"), F.sum(F.when(F.col("c") < 0, F.col("n")).otherwise(0)).alias("noise"))
    found = {r["s"]: (r["k"], r["noise"]) for r in counts.collect()}
    db = davies_bouldins(labels, cols, "labels", "w")
    points = stable(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).join(labels.drop("w"), cols))
    if mode == "exact":
        sil = silhouettes(points, cols, "labels", key)
    else:
        one = [points.withColumn("cluster", F.get("labels", F.lit(s))) if v is not None else None for s, v in enumerate(db)]
        sil = [None if p is None else float(silhouette(p, cols, key, mode=mode).first()["silhouette"]) for p in one]
    rows = [(e, m, *map(int, found[s]), db[s], sil[s]) for s, (e, m) in enumerate(settings) if s in found]
    schema = "eps double, min_pts int, n_clusters int, n_noise long, davies_bouldin double, silhouette double"
    return df.sparkSession.createDataFrame(rows, schema)
