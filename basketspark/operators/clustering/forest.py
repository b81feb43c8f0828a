"""Minimum spanning forests over leaves of points.

A component's shortest link to another one belongs to the tree. Inside a leaf it is certain as long as it is shorter than
the way to any other leaf, so most of the tree is grown leaf by leaf in one job. After that a round visits only leaves
that lie within the shortest link a component is known to have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import stable
from ..graph import connected_components
from ..spatial import _BOX_CELLS, _NARROWER, _PAIRS, _WIDER, Boxes, distances, meet

#: links of a round that the driver joins itself
COLLECTED_LINKS = 50_000
_LINK = "m int, comp long, w double, d double, a long, b long, to long"


def joined(links: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected with each of 0 to ``n`` - 1 by rows of ``links``."""
    root = np.arange(n)
    while len(links):
        low = root[links].min(axis=1)
        np.minimum.at(root, root[links[:, 0]], low)
        np.minimum.at(root, root[links[:, 1]], low)
        while (root[root] != root).any():
            root = root[root]
        links = links[root[links[:, 0]] != root[links[:, 1]]]
    return root


def _length(gap: np.ndarray, p: int) -> np.ndarray:
    return gap.sum(axis=-1) if p == 1 else np.sqrt((gap * gap).sum(axis=-1))


def _room(boxes: Boxes, at: int, x: np.ndarray, p: int) -> np.ndarray:
    """A distance below that of each row of ``x``, points of the leaf ``at``, to all points of other leaves."""
    apart = _length(np.maximum(np.maximum(boxes.lo - boxes.hi[at], boxes.lo[at] - boxes.hi), 0.0), p)
    near = apart <= _length(boxes.hi[at] - boxes.lo[at], p)
    near[at], apart[at] = False, np.inf
    out = np.full(len(x), apart[~near].min(initial=np.inf))
    beside = boxes.some(near)
    for s in range(0, len(x) if near.any() else 0, step := beside.row_chunk()):
        out[s : s + step] = np.minimum(out[s : s + step], beside.near(x[s : s + step], p).min(axis=1))
    return out * _NARROWER


def _shortest(x, cd, comp, px, pcd, pcomp, reach: float, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``px``, length, distance) of each row's shortest link to a point of another component, infinite if there is none.

    Points are as far apart as their distance or the larger of their ``cd``. Of links of one length the one of the smaller
    distance is taken, then the one to the first point.
    """
    j, low, gap = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), np.inf)
    for s in range(0, len(x), step := max(1, 8 * _PAIRS // max(1, len(px)))):
        rows = slice(s, s + step)
        d = distances(x[rows], px, p)
        w = np.maximum(np.maximum(d, cd[rows, None]), pcd[None])
        w[(comp[rows, None] == pcomp[None]) | ~(w <= reach)] = np.inf
        low[rows] = w.min(axis=1)
        d[w != low[rows, None]] = np.inf
        j[rows] = d.argmin(axis=1)
        gap[rows] = d[np.arange(len(d)), j[rows]]
    return j, low, gap


def _first_of_each(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Position of the smallest row, by ``keys`` from the first on, of every group in ascending order."""
    order = np.lexsort((*keys[::-1], group))
    return order[np.unique(group[order], return_index=True)[1]]


def _grown(x: np.ndarray, cd: np.ndarray, room: np.ndarray, reach: float, p: int) -> tuple[np.ndarray, list]:
    """(component of each row, links [row, row, length]) of the part of the tree that a leaf's points alone show."""
    comp, links = np.arange(len(x)), []
    j, w, d = _shortest(x, cd, comp, x, cd, comp, reach, p)
    least = np.maximum(room, cd)  # a link that leaves the leaf is no shorter
    while True:
        i = np.arange(len(x))
        best = _first_of_each(comp, w, d, np.minimum(i, j), np.maximum(i, j))
        out = _first_of_each(comp, least, room)
        sure = np.isfinite(w[best]) & ((w[best] < least[out]) | ((w[best] == least[out]) & (d[best] < room[out])))
        if not sure.any():
            return comp, links
        best = best[sure]
        found = np.unique(np.stack([np.minimum(best, j[best]), np.maximum(best, j[best])], axis=1), axis=0)
        length = dict(zip(zip(np.minimum(best, j[best]).tolist(), np.maximum(best, j[best]).tolist()), w[best].tolist()))
        links += [(a, b, length[a, b]) for a, b in found.tolist()]
        comp = joined(comp[found], len(x))[comp]
        old = np.flatnonzero((comp == comp[j]) & np.isfinite(w))
        j[old], w[old], d[old] = _shortest(x[old], cd[old], comp[old], x, cd, comp, reach, p)


def _best_links(m: int, q: pd.DataFrame, pts: pd.DataFrame, cols: list[str], reach: float, p: int) -> pd.DataFrame:
    """The shortest link of every component of ``q`` to points of other components."""
    if not len(q) or not len(pts):
        return pd.DataFrame({c.split()[0]: [] for c in _LINK.split(", ")})
    pts = pts.sort_values("pid")
    at = [(t[cols].to_numpy(dtype=float), t["cd"].to_numpy(dtype=float), t["comp"].to_numpy()) for t in (q, pts)]
    j, w, d = _shortest(*at[0], *at[1], reach, p)
    own, other, comp = q["pid"].to_numpy(), pts["pid"].to_numpy()[j], at[0][2]
    a, b = np.minimum(own, other), np.maximum(own, other)
    best = _first_of_each(comp, w, d, a, b)
    best = best[np.isfinite(w[best])]
    found = {"m": m, "comp": comp[best], "w": w[best], "d": d[best], "a": a[best], "b": b[best], "to": at[1][2][j[best]]}
    return pd.DataFrame(found)


def _box_bounds(boxes: Boxes, name: np.ndarray, p: int) -> dict[int, float]:
    """For each component that owns leaves wholly (``name``, else -1): within this distance lies a point of another one."""
    out: dict[int, float] = {}
    own = np.flatnonzero(name >= 0)
    for s in range(0, len(own), step := max(1, _BOX_CELLS // max(1, boxes.lo.size))):
        rows = own[s : s + step]
        far = _length(np.maximum(boxes.hi[None] - boxes.lo[rows, None], boxes.hi[rows, None] - boxes.lo[None]), p)
        far[name[rows, None] == name[None]] = np.inf
        for c, v in zip(name[rows].tolist(), far.min(axis=1).tolist()):
            out[c] = min(v, out.get(c, np.inf))
    return out


def spanning_forest(points: DataFrame, boxes: Boxes, cols: Sequence[str], p: int = 2, reach: float | None = None) -> DataFrame:
    """(m, a, b, w): minimum spanning forests with links of at most ``reach``.

    ``points`` has m (the number of a forest, from 0), pid, leaf, the columns and cd; the forests' points are apart as
    :func:`_shortest` says, and ``boxes`` are the leaves' boxes over all forests. All forests grow in the same rounds.
    """
    cols, spark = list(cols), points.sparkSession
    most = np.inf if reach is None else float(reach)
    place = {int(leaf): i for i, leaf in enumerate(boxes.leaf)}
    kinds = dict(points.dtypes)
    base = ["m", "pid", "leaf", *cols, "cd"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in base) + ", comp long, room double, a long, b long, w double"

    def settle(key: tuple, pts: pd.DataFrame) -> pd.DataFrame:
        pts = pts.sort_values("pid")
        x, ids = pts[cols].to_numpy(dtype=float), pts["pid"].to_numpy()
        room = _room(boxes, place[int(key[1])], x, p)
        comp, links = _grown(x, pts["cd"].to_numpy(dtype=float), room, most, p)
        # fewer links than points
        a, b, w = (pd.array([pd.NA] * len(x), kind) for kind in ("Int64", "Int64", "Float64"))
        for i, (u, v, length) in enumerate(links):
            a[i], b[i], w[i] = ids[u], ids[v], length
        return pts[base].assign(comp=ids[comp], room=room, a=a, b=b, w=w)

    grown = stable(points.select(*base).groupBy("m", "leaf").applyInPandas(settle, schema))
    forest = grown.where("a is not null").select("m", "a", "b", "w")
    points = grown.select(*base, "comp", "room")
    trees = 0

    def inside(key: tuple, pts: pd.DataFrame) -> pd.DataFrame:
        mixed = pts["comp"].nunique() > 1
        return _best_links(int(key[0]), pts if mixed else pts[:0], pts, cols, most, p)

    while True:
        seen = points.groupBy("leaf", "m").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).toPandas()
        trees = trees or (int(seen["m"].max()) + 1 if len(seen) else 1)
        held, pure, name = np.zeros((3, len(boxes.leaf), trees), np.int64)
        at = np.array([place[int(leaf)] for leaf in seen["leaf"]], np.int64), seen["m"].to_numpy(dtype=np.int64)
        held[at], pure[at], name[at] = 1, seen["low"] == seen["high"], seen["low"]
        if not ((held == 1) & (pure == 0)).any() and all(len(np.unique(name[held[:, m] == 1, m])) < 2 for m in range(trees)):
            return forest
        local = stable(points.groupBy("m", "leaf").applyInPandas(inside, _LINK))
        known = local.groupBy("m", "comp").agg(F.min("w").alias("within"))
        if reach is None:
            # a component of whole leaves only has no link inside a leaf
            rows = []
            for m in range(trees):
                codes, own = np.unique(name[:, m], return_inverse=True)
                own = np.where((pure[:, m] == 1) & (held[:, m] == 1), own, -1)
                here = boxes.some(held[:, m] == 1)
                rows += [(m, int(codes[c]), float(v)) for c, v in _box_bounds(here, own[held[:, m] == 1], p).items() if np.isfinite(v)]
            if rows:
                widest = points.agg(F.max("cd")).first()[0]
                rows = [(m, c, max(v, widest)) for m, c, v in rows]
                known = known.unionByName(spark.createDataFrame(rows, "m int, comp long, within double"))
                known = known.groupBy("m", "comp").agg(F.min("within").alias("within"))
        asked = points.join(known, ["m", "comp"], "left").withColumn("within", F.coalesce("within", F.lit(most)))
        asked = asked.where(F.greatest("room", "cd") <= F.col("within") * _WIDER).drop("room")

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for s in range(0, len(batch), step := boxes.row_chunk()):
                    part = batch.iloc[s : s + step]
                    m = part["m"].to_numpy()
                    go = boxes.near(part[cols].to_numpy(dtype=float), p) <= part["within"].to_numpy()[:, None] * _WIDER
                    go &= (held[:, m].T == 1) & (boxes.leaf[None] != part["leaf"].to_numpy()[:, None])
                    go &= (pure[:, m].T == 0) | (name[:, m].T != part["comp"].to_numpy()[:, None])
                    qi, bi = np.nonzero(go)
                    yield part.iloc[qi].assign(to_leaf=boxes.leaf[bi] * trees + m[qi])

        def closest(q: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
            return _best_links(int(q["m"].iloc[0]) if len(q) else 0, q, pts, cols, most, p)

        routed = asked.mapInPandas(visit, T.StructType([*asked.schema.fields, T.StructField("to_leaf", T.LongType())]))
        there = points.drop("room").withColumn("leaf", F.col("leaf") * trees + F.col("m"))
        met = meet(routed, there, closest, _LINK).unionByName(local)
        best = stable(met.groupBy("m", "comp").agg(F.min(F.struct("w", "d", "a", "b", "to")).alias("e")).select("m", "comp", "e.*"))
        n = best.count()
        if not n:
            return forest
        forest = forest.unionByName(best.select("m", "a", "b", "w").distinct())
        roots = _roots(best, n, spark)
        # a component without a link is finished, and no other one reaches it
        points = stable(points.join(roots, ["m", "comp"]).drop("comp").withColumnRenamed("root", "comp").select(*base, "comp", "room"))


def _roots(best: DataFrame, n: int, spark) -> DataFrame:
    """(m, comp, root): the smallest component joined with each by the links of a round."""
    if n <= COLLECTED_LINKS:
        t = best.select("m", "comp", "to").toPandas()
        pairs = pd.MultiIndex.from_frame(t[["m", "comp"]])
        order = pairs.argsort()
        pairs = pairs[order]
        links = np.stack([pairs.get_indexer(pd.MultiIndex.from_frame(t[["m", c]].rename(columns={c: "comp"}))) for c in ("comp", "to")], axis=1)
        root = pairs[joined(links, len(pairs))].get_level_values(1)
        out = pd.DataFrame({"m": pairs.get_level_values(0), "comp": pairs.get_level_values(1), "root": root})
        return spark.createDataFrame(out, "m int, comp long, root long")
    name = F.col("m").cast("long") * (1 << 40)
    links = best.select((name + F.col("comp")).alias("u"), (name + F.col("to")).alias("v"))
    found = connected_components(links.select(F.col("u").alias("v")), links)
    keys = best.select("m", "comp", (name + F.col("comp")).alias("v"))
    return keys.join(found, "v").select("m", "comp", (F.col("root") - name).alias("root"))
