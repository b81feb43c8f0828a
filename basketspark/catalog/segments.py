"""Customer segmentation on recency, frequency and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rnd as rnd_col
from ..operators import features, profile
from ..operators.clustering import density, linkage, metrics, partition
from ..sources.retail import lines, stored_lines
from .base import rnd, with_profile
from .clean_profile import RFM, min_max_sql

QUERIES = {}
ORACLE = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def _rfm(s, d):
    return profile.basket_features(lines(s, d)).select("customer_id", *RFM)


def _scaled(s, d):
    return features.cluster_input(_rfm(s, d), RFM, "min_max")


SCALED = f"""mm AS ({min_max_sql(RFM, 'profile')}),
sc AS MATERIALIZED (SELECT customer_id, recency AS x, frequency AS y, monetary AS z FROM mm)"""
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
PAIRS = f"""pd AS MATERIALIZED (SELECT a.customer_id AS i, b.customer_id AS j, {_D} AS d FROM sc a, sc b)"""

EPS, MIN_PTS, HEIGHT = 0.046, 4, 0.03


def _rounds(edges: str, nodes: str, n: int = 14) -> str:
    """Label rounds: smallest label among neighbours, then two pointer jumps."""
    out = [f"l0 AS MATERIALIZED (SELECT i, i AS c FROM {nodes})"]
    for r in range(1, n + 1):
        out.append(
            f"h{r} AS MATERIALIZED (SELECT e.i, min(l.c) AS c FROM {edges} e JOIN l{r - 1} l ON l.i = e.j GROUP BY 1)"
        )
        out.append(f"j{r} AS MATERIALIZED (SELECT a.i, least(a.c, b.c) AS c FROM h{r} a JOIN h{r} b ON b.i = a.c)")
        out.append(f"l{r} AS MATERIALIZED (SELECT a.i, least(a.c, b.c) AS c FROM j{r} a JOIN j{r} b ON b.i = a.c)")
    return ",\n".join(out) + f",\nroots AS (SELECT i, c AS root FROM l{n})"


def _dbscan_sql(eps: float, min_pts: int) -> str:
    return f""", {SCALED}, {PAIRS},
core AS MATERIALIZED (SELECT i FROM pd WHERE d <= {eps} GROUP BY i HAVING count(*) >= {min_pts}),
ce AS MATERIALIZED (SELECT i, j FROM pd WHERE d <= {eps} AND i IN (FROM core) AND j IN (FROM core)),
{_rounds('ce', 'core')},
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots)),
lab AS (SELECT i, root FROM roots UNION ALL
  SELECT pd.i, min(root) FROM pd JOIN roots ON roots.i = pd.j WHERE d <= {eps} AND pd.i NOT IN (FROM core) GROUP BY 1),
clusters AS (SELECT customer_id, coalesce(cluster, -1) AS cluster FROM sc LEFT JOIN lab ON lab.i = customer_id
  LEFT JOIN num USING (root))"""


_add(
    "dbscan",
    lambda s, d: density.dbscan(_scaled(s, d), RFM, EPS, MIN_PTS).withColumn("cluster", F.col("cluster").cast("long")),
    with_profile(_dbscan_sql(EPS, MIN_PTS) + " SELECT * FROM clusters"),
)
_add(
    "single_linkage_cut",
    lambda s, d: density.single_linkage(_scaled(s, d), RFM, HEIGHT).withColumn(
        "cluster", F.col("cluster").cast("long")
    ),
    with_profile(
        f""", {SCALED}, {PAIRS}, ce AS MATERIALIZED (SELECT i, j FROM pd WHERE d <= {HEIGHT}),
nd AS (SELECT customer_id AS i FROM sc), {_rounds('ce', 'nd')},
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots))
SELECT i AS customer_id, cluster FROM roots JOIN num USING (root)"""
    ),
)
_add(
    "k_distance",
    lambda s, d: density.k_distance(_scaled(s, d), RFM, 4).select("customer_id", rnd_col("dist", 8).alias("dist")),
    with_profile(
        f""", {SCALED}, {PAIRS} SELECT i AS customer_id, {rnd('d', 8)} AS dist FROM pd WHERE i <> j
QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4"""
    ),
)
_add(
    "optics_reachability",
    lambda s, d: density.optics(_scaled(s, d), RFM, 0.06, 4).select(
        "customer_id",
        F.col("cluster").cast("long").alias("cluster"),
        rnd_col("core_dist", 8).alias("core_dist"),
        rnd_col("reachability", 8).alias("reachability"),
    ),
    with_profile(
        _dbscan_sql(0.06, 5)
        + f""", cd AS (SELECT i, d AS core_dist FROM (SELECT * FROM pd WHERE i <> j
    QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4) WHERE d <= 0.06),
rc AS (SELECT pd.i, min(greatest(core_dist, d)) AS reachability FROM pd JOIN cd ON cd.i = pd.j
  WHERE d <= 0.06 AND pd.i <> pd.j GROUP BY 1)
SELECT customer_id, cluster, {rnd('core_dist', 8)} AS core_dist, {rnd('reachability', 8)} AS reachability
FROM clusters LEFT JOIN cd ON cd.i = customer_id LEFT JOIN rc ON rc.i = customer_id"""
    ),
)

# the same results from many small leaves, as large tables have them
SMALL_LEAF = 64
_add(
    "dbscan_many_leaves",
    lambda s, d: density.dbscan(_scaled(s, d), RFM, EPS, MIN_PTS, leaf_rows=SMALL_LEAF).withColumn(
        "cluster", F.col("cluster").cast("long")
    ),
    ORACLE["dbscan"],
)
_add(
    "single_linkage_cut_many_leaves",
    lambda s, d: density.single_linkage(_scaled(s, d), RFM, HEIGHT, leaf_rows=SMALL_LEAF).withColumn(
        "cluster", F.col("cluster").cast("long")
    ),
    ORACLE["single_linkage_cut"],
)
_add(
    "k_distance_many_leaves",
    lambda s, d: density.k_distance(_scaled(s, d), RFM, 4, leaf_rows=SMALL_LEAF).select(
        "customer_id", rnd_col("dist", 8).alias("dist")
    ),
    ORACLE["k_distance"],
)

# ---- k-means from fixed centres, and everything measured on its clusters --------------------------

START = [[0.2, 0.2, 0.2], [0.5, 0.5, 0.5], [0.8, 0.8, 0.8]]
STEPS = 4


def _lloyd(s, d):
    return partition.lloyd(_scaled(s, d), RFM, START, STEPS)[0]


def _lloyd_sql() -> str:
    def assign(r: int) -> str:
        dist = [f"(x - x{j}) * (x - x{j}) + (y - y{j}) * (y - y{j}) + (z - z{j}) * (z - z{j}) AS d{j}" for j in range(3)]
        return f"""a{r} AS MATERIALIZED (SELECT customer_id, x, y, z,
  CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster
  FROM (SELECT customer_id, x, y, z, {', '.join(dist)} FROM sc, m{r}))"""

    names = [f"{v}{j}" for j in range(3) for v in "xyz"]
    flat = [v for c in START for v in c]
    out = [SCALED, "m0 AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in zip(names, flat)) + ")"]
    for r in range(STEPS):
        means = ", ".join(
            f"coalesce({rnd(f'avg({n[0]}) FILTER (cluster = {n[1]})', 6)}, (SELECT {n} FROM m{r})) AS {n}" for n in names
        )
        out += [assign(r), f"m{r + 1} AS MATERIALIZED (SELECT {means} FROM a{r})"]
    out += [assign(STEPS), f"km AS MATERIALIZED (SELECT * FROM a{STEPS})"]
    return ",\n".join(out)


LLOYD = _lloyd_sql()
_add(
    "kmeans_fixed_start",
    lambda s, d: _lloyd(s, d).select("customer_id", "cluster"),
    with_profile(f", {LLOYD} SELECT customer_id, CAST(cluster AS INT) AS cluster FROM km"),
)
_SIL = f"""pt AS (SELECT a.customer_id AS i, a.cluster AS c, b.cluster AS o, sum({_D}) AS t, count(*) AS n
  FROM km a, km b GROUP BY 1, 2, 3),
ab AS (SELECT i, c, max(t / (n - 1)) FILTER (c = o AND n > 1) AS a, min(t / n) FILTER (c <> o) AS b FROM pt GROUP BY 1, 2),
sil AS (SELECT i AS customer_id, c AS cluster, a, b,
  CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)"""
_add(
    "silhouette_exact",
    lambda s, d: metrics.silhouette(_lloyd(s, d), RFM).select("silhouette"),
    with_profile(f", {LLOYD}, {_SIL} SELECT {rnd('avg(s)', 4)} AS silhouette FROM sil"),
)
_add(
    "silhouette_points",
    lambda s, d: metrics.silhouette_points(_lloyd(s, d), RFM).select(
        "customer_id", "cluster", *[rnd_col(c, 6).alias(c) for c in ("a", "b", "s")]
    ),
    with_profile(
        f""", {LLOYD}, {_SIL} SELECT customer_id, CAST(cluster AS INT) AS cluster,
  {rnd('a', 6)} AS a, {rnd('b', 6)} AS b, {rnd('s', 6)} AS s FROM sil"""
    ),
)
_add(
    "silhouette_squared",
    lambda s, d: metrics.silhouette(_lloyd(s, d), RFM, mode="squared").select(rnd_col("silhouette", 4).alias("silhouette")),
    with_profile(f", {LLOYD}, {_SIL.replace(_D, f'{_D} * {_D}')} SELECT {rnd('avg(s)', 4)} AS silhouette FROM sil"),
)
_CEN = """cen AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM km GROUP BY 1)"""
_add(
    "davies_bouldin",
    lambda s, d: metrics.davies_bouldin(_lloyd(s, d), RFM),
    with_profile(
        f""", {LLOYD}, {_CEN},
sp AS (SELECT b.cluster, b.x, b.y, b.z, avg({_D}) AS s FROM km a JOIN cen b ON a.cluster = b.cluster GROUP BY 1, 2, 3, 4),
w AS (SELECT a.cluster, max((a.s + b.s) / {_D}) AS r FROM sp a JOIN sp b ON a.cluster <> b.cluster GROUP BY 1)
SELECT {rnd('avg(r)', 4)} AS davies_bouldin FROM w"""
    ),
)
_add(
    "inertia",
    lambda s, d: metrics.inertia(_lloyd(s, d), RFM),
    with_profile(
        f""", {LLOYD}, {_CEN} SELECT {rnd(f'sum(({_D}) * ({_D}))', 4)} AS sse FROM km a JOIN cen b ON a.cluster = b.cluster"""
    ),
)


def _with_clusters(s, d):
    return profile.customer_profile(stored_lines(s, d)).join(_lloyd(s, d).select("customer_id", "cluster"), "customer_id")


_add(
    "assign_clusters",
    lambda s, d: _with_clusters(s, d).select("customer_id", "cluster", "recency", "main_country"),
    with_profile(
        f""", {LLOYD} SELECT customer_id, CAST(cluster AS INT) AS cluster, recency, main_country
FROM km JOIN profile USING (customer_id)"""
    ),
)


def _mode_sql(col: str) -> str:
    return f"""md_{col} AS (SELECT cluster, {col} FROM cp2 GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {col}) = 1)"""


_MODES = ["item_pref", "main_country", "weekday_pref", "weekmonth_pref"]
_add(
    "cluster_profile",
    lambda s, d: metrics.cluster_profile(_with_clusters(s, d), lines(s, d)),
    with_profile(
        f""", {LLOYD}, cp2 AS (SELECT profile.*, CAST(cluster AS INT) AS cluster FROM km JOIN profile USING (customer_id)),
{', '.join(_mode_sql(c) for c in _MODES)},
pn AS (SELECT prod_id AS item_pref, min(prod_descr) AS item_pref_descr FROM lines GROUP BY 1),
g AS (SELECT cluster, count(*) AS n, {rnd('avg(p_return)', 4)} AS mean_p_return,
  {rnd('avg(mean_item_sale)', 4)} AS mean_mean_item_sale FROM cp2 GROUP BY 1)
SELECT * FROM g {' '.join(f'JOIN md_{c} USING (cluster)' for c in _MODES)} LEFT JOIN pn USING (item_pref)"""
    ),
)
_add(
    "cluster_boxes",
    lambda s, d: metrics.cluster_boxes(_with_clusters(s, d), RFM),
    with_profile(
        f""", {LLOYD}, lg AS (UNPIVOT (SELECT CAST(cluster AS INT) AS cluster, CAST(recency AS DOUBLE) AS recency,
    CAST(frequency AS DOUBLE) AS frequency, CAST(monetary AS DOUBLE) AS monetary FROM km JOIN profile USING (customer_id))
  ON recency, frequency, monetary INTO NAME attribute VALUE x),
qq AS (SELECT cluster, attribute, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3 FROM lg GROUP BY 1, 2),
ins AS (SELECT *, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS inside FROM lg JOIN qq USING (cluster, attribute))
SELECT cluster, attribute, count(*) AS n, {rnd('max(q1)', 4)} AS q1, {rnd('max(median)', 4)} AS median,
  {rnd('max(q3)', 4)} AS q3, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_outliers FROM ins GROUP BY 1, 2"""
    ),
)
_CT = "\nUNION ALL ".join(
    f"""SELECT CAST(cluster AS INT) AS cluster, count(*) AS n, '{c}' AS attribute, {rnd(f'avg({v})', 4)} AS scaled,
  {rnd(f'avg(CAST({c} AS DOUBLE))', 4)} AS original FROM km JOIN profile USING (customer_id) GROUP BY cluster"""
    for c, v in zip(RFM, "xyz")
)
_add(
    "centroid_table",
    lambda s, d: metrics.centroid_table(_lloyd(s, d), _rfm(s, d), RFM),
    with_profile(f", {LLOYD} {_CT}"),
)

# ---- fuzzy c-means from fixed centres -------------------------------------------------------------

FUZZY_STEPS, FUZZY_M = 2, 2.1


def _fuzzy(s, d):
    out, _ = partition.fuzzy_cmeans(_scaled(s, d), RFM, START, FUZZY_M, FUZZY_STEPS, tolerance=0.0)
    return out.select(
        "customer_id", "cluster", *[rnd_col(F.col("memberships")[j], 4).alias(f"u{j}") for j in range(len(START))]
    )


def _fuzzy_sql() -> str:
    names = [f"{v}{j}" for j in range(3) for v in "xyz"]
    flat = [v for c in START for v in c]
    out = [SCALED, "m0 AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in zip(names, flat)) + ")"]

    def member(r: int) -> str:
        dist = ", ".join(
            f"(x - x{j}) * (x - x{j}) + (y - y{j}) * (y - y{j}) + (z - z{j}) * (z - z{j}) AS d{j}" for j in range(3)
        )
        p = 1.0 / (FUZZY_M - 1.0)
        inv = [f"pow(1.0 / d{j}, CAST({p!r} AS DOUBLE))" for j in range(3)]
        us = ", ".join(f"{inv[j]} / ({' + '.join(inv)}) AS u{j}" for j in range(3))
        return f"f{r} AS MATERIALIZED (SELECT customer_id, x, y, z, {us} FROM (SELECT customer_id, x, y, z, {dist} FROM sc, m{r}))"

    for r in range(FUZZY_STEPS):
        w = [f"pow(u{j}, CAST({FUZZY_M} AS DOUBLE))" for j in range(3)]
        means = ", ".join(f"{rnd(f'sum({w[int(n[1])]} * {n[0]}) / sum({w[int(n[1])]})', 6)} AS {n}" for n in names)
        out += [member(r), f"m{r + 1} AS MATERIALIZED (SELECT {means} FROM f{r})"]
    out.append(member(FUZZY_STEPS))
    return ",\n".join(out)


_add(
    "fuzzy_cmeans_fixed_start",
    _fuzzy,
    with_profile(
        f""", {_fuzzy_sql()} SELECT customer_id, CAST(CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS INT) AS cluster,
  {rnd('u0', 4)} AS u0, {rnd('u1', 4)} AS u1, {rnd('u2', 4)} AS u2 FROM f{FUZZY_STEPS}"""
    ),
)

# SQL would need every pair of components in every round; the tests compare with a plain loop
_add("single_linkage_tree", lambda s, d: linkage.single_linkage_tree(_scaled(s, d), RFM))

# ---- seeded algorithms ----------------------------------------------------------------------------


def _standard(s, d):
    return features.cluster_input(_rfm(s, d), RFM)


# the published settings
DBSCAN_EPS, DBSCAN_MIN_PTS = [x / 1000 for x in range(10, 100)], list(range(2, 10))
NOT_NUMERIC = ("customer_id", "item_pref", "main_country", "weekday_pref", "weekmonth_pref", "p_return")


def _dbscan_grid(s, d):
    return density.dbscan_grid(_scaled(s, d), RFM, eps_values=DBSCAN_EPS, min_pts_values=DBSCAN_MIN_PTS)


def _feature_search(s, d):
    found = profile.customer_profile(stored_lines(s, d))
    cols = [c for c in found.columns if c not in NOT_NUMERIC]
    return partition.feature_search(features.cluster_input(found, cols, "min_max"), cols)


_add("dbscan_grid", _dbscan_grid)
_add(
    "kmeans_restarts",
    lambda s, d: partition.kmeans(_standard(s, d), RFM, 5, n_init=100, max_iter=1000)[0].select("customer_id", "cluster"),
)
_add("elbow", lambda s, d: partition.elbow(_standard(s, d), RFM))
_add("feature_search", _feature_search)
_add("xmeans", lambda s, d: partition.xmeans(_scaled(s, d), RFM)[0].select("customer_id", "cluster"))


def _fuzzy_search(s, d):
    pts = _scaled(s, d)
    start = partition.farthest_start(pts, RFM, 5)
    return partition.fuzzy_cmeans(pts, RFM, start, 2.0)[0].select("customer_id", "cluster", "memberships")


_add("fuzzy_cmeans_farthest_start", _fuzzy_search)
_add("gaussian_mixture", lambda s, d: partition.gaussian_mixture(_scaled(s, d), RFM, 5)[0])
_add("gaussian_mixture_components", lambda s, d: partition.gaussian_mixture(_scaled(s, d), RFM, 5)[1])
_add(
    "evolved_centres",
    lambda s, d: partition.evolve_centres(
        features.min_max_scale(_rfm(s, d), RFM, 0.01, 0.99), RFM
    )[0].select("customer_id", "cluster"),
)
