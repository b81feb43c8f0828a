"""Sequence building and pattern mining; the item is the product description."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import stable, stored
from ..operators.sequences import build, mining, report
from ..operators.sequences import pattern as P
from ..sources.io import bought
from ..sources.retail import lines, table
from .base import rnd, with_lines

QUERIES = {}
ORACLE = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


MIN_BASKETS, MIN_SUP = 10, 0.15


def _kept(s, d, n=MIN_BASKETS):
    return build.min_basket_customers(bought(lines(s, d)), n)


def _occ(s, d, order="time", n=MIN_BASKETS):
    return stored(build.occurrences(_kept(s, d, n), "prod_descr", order))


def _text(df, *cols):
    return df.select(P.text(F.col("pattern")).alias("pattern_text"), *cols)


def _kept_sql(n: int) -> str:
    return f"""kept AS (SELECT * FROM lines WHERE qta > 0 AND customer_id IN
  (SELECT customer_id FROM lines WHERE qta > 0 GROUP BY 1 HAVING count(DISTINCT basket_id) >= {n}))"""


KEPT = _kept_sql(MIN_BASKETS)


def _occ_sql(order: str = "ts, basket_id", n: int = MIN_BASKETS) -> str:
    return f"""{_kept_sql(n)},
place AS MATERIALIZED (SELECT customer_id AS seq_id, basket_id, max(purchase_ts) AS ts FROM kept GROUP BY 1, 2),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY {order}) - 1 AS pos FROM place),
occ AS MATERIALIZED (SELECT seq_id, pos, ts, item, qta FROM (SELECT customer_id AS seq_id, basket_id, prod_descr AS item,
  CAST(sum(qta) AS BIGINT) AS qta FROM kept GROUP BY 1, 2, 3) JOIN pl USING (seq_id, basket_id)),
nseq AS (SELECT count(DISTINCT seq_id) AS n FROM occ)"""


OCC = _occ_sql()
ENDS = "ends AS MATERIALIZED (SELECT seq_id, item, min(pos) AS lo, max(pos) AS hi, min(ts) AS lo_ts FROM occ GROUP BY 1, 2)"
# leftmost match of every ordered pair: first a, then the first b after it
PAIR = f"""{ENDS},
mt AS MATERIALIZED (SELECT e.seq_id, e.item AS a, o.item AS b, e.lo AS p1, min(o.pos) AS p2, e.lo_ts AS t1, min(o.ts) AS t2
  FROM ends e JOIN occ o ON o.seq_id = e.seq_id AND o.pos > e.lo GROUP BY ALL)"""


def _mined_sql(min_sup: float) -> str:
    """Levels 1 and 2, and three-item patterns of single items, by direct counting."""
    return f"""{PAIR},
f1 AS (SELECT item, count(*) AS c FROM ends GROUP BY 1 HAVING count(*) >= {min_sup} * (SELECT n FROM nseq)),
f2 AS MATERIALIZED (SELECT a, b, count(*) AS c FROM mt GROUP BY 1, 2 HAVING count(*) >= {min_sup} * (SELECT n FROM nseq)),
g2 AS (SELECT x.item AS a, y.item AS b, count(DISTINCT x.seq_id) AS c FROM occ x JOIN occ y
  ON x.seq_id = y.seq_id AND x.pos = y.pos AND x.item < y.item GROUP BY 1, 2
  HAVING count(DISTINCT x.seq_id) >= {min_sup} * (SELECT n FROM nseq)),
f3 AS (SELECT a, b, item, count(DISTINCT seq_id) AS c FROM mt JOIN f2 USING (a, b) JOIN occ USING (seq_id)
  WHERE pos > p2 GROUP BY 1, 2, 3 HAVING count(DISTINCT seq_id) >= {min_sup} * (SELECT n FROM nseq)),
mined AS (SELECT '[' || item || ']' AS pattern_text, 1 AS n_items, 1 AS n_elements, c FROM f1
  UNION ALL SELECT '[' || a || '][' || b || ']', 2, 2, c FROM f2
  UNION ALL SELECT '[' || a || ',' || b || ']', 2, 1, c FROM g2
  UNION ALL SELECT '[' || a || '][' || b || '][' || item || ']', 3, 3, c FROM f3)"""


_add(
    "min_basket_customers",
    lambda s, d: _kept(s, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_lines")),
    with_lines(f", {KEPT} SELECT customer_id, count(*) AS n_lines FROM kept GROUP BY 1"),
)
_add(
    "sequentialize",
    lambda s, d: build.sequentialize(_kept(s, d), "prod_descr").select(
        "seq_id", "pos", "ts", F.array_join("items", ",").alias("items")
    ),
    with_lines(
        f""", {OCC} SELECT seq_id, pos, ts, string_agg(item, ',' ORDER BY item) AS items FROM occ GROUP BY 1, 2, 3"""
    ),
)
_add(
    "frequent_items",
    lambda s, d: _text(mining.frequent_items(_occ(s, d), MIN_SUP), "support_count", mining.rnd("support", 6).alias("support")),
    with_lines(
        f""", {OCC}, {ENDS} SELECT '[' || item || ']' AS pattern_text, count(*) AS support_count,
  {rnd('count(*) / CAST((SELECT n FROM nseq) AS DOUBLE)', 6)} AS support FROM ends GROUP BY item
HAVING count(*) >= {MIN_SUP} * (SELECT n FROM nseq)"""
    ),
)
_add(
    "pair_support",
    lambda s, d: _text(mining.pair_counts(_occ(s, d)), "support_count"),
    with_lines(
        f""", {OCC}, {ENDS} SELECT '[' || a.item || '][' || b.item || ']' AS pattern_text, count(*) AS support_count
FROM ends a JOIN ends b ON a.seq_id = b.seq_id AND a.lo < b.hi GROUP BY a.item, b.item
UNION ALL SELECT '[' || x.item || ',' || y.item || ']', count(DISTINCT x.seq_id) FROM occ x JOIN occ y
ON x.seq_id = y.seq_id AND x.pos = y.pos AND x.item < y.item GROUP BY x.item, y.item"""
    ),
)


def _gsp(s, d, sup=MIN_SUP, limits=mining.TimeLimits()):
    return mining.gsp(_occ(s, d), sup, limits)


_add(
    "gsp_untimed",
    lambda s, d: _text(_gsp(s, d), "n_items", "n_elements", "support_count"),
    with_lines(
        f""", {OCC}, {_mined_sql(MIN_SUP)}
SELECT pattern_text, CAST(n_items AS INT) AS n_items, CAST(n_elements AS INT) AS n_elements, c AS support_count FROM mined"""
    ),
)
for _name, _kw, _cond in (
    ("min_gap", {"min_gap": timedelta(days=60)}, "t2 - t1 >= INTERVAL 60 DAY"),
    ("max_gap", {"max_gap": timedelta(days=1600)}, "t2 - t1 <= INTERVAL 1600 DAY"),
    ("max_span", {"max_span": timedelta(days=1500)}, "t2 - t1 <= INTERVAL 1500 DAY"),
):
    _add(
        f"gsp_{_name}",
        lambda s, d, kw=_kw: _text(
            _gsp(s, d, 0.13, mining.TimeLimits(**kw)), "n_elements", "support_count"
        ),
        with_lines(
            f""", {OCC}, {PAIR},
f1 AS (SELECT item, count(*) AS c FROM ends GROUP BY 1 HAVING count(*) >= 0.13 * (SELECT n FROM nseq))
SELECT '[' || item || ']' AS pattern_text, CAST(1 AS INT) AS n_elements, c AS support_count FROM f1
UNION ALL SELECT '[' || a || '][' || b || ']', CAST(2 AS INT), count(*) FROM mt WHERE {_cond} GROUP BY a, b
HAVING count(*) >= 0.13 * (SELECT n FROM nseq)"""
        ),
    )


# ---- brands as items: few values, so that patterns of three items are frequent ----------------------

BRAND_SUP = 0.19


def _brand_occ(s, d):
    brands = table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("prod_id"), F.col("p_brand").alias("brand")
    )
    return stored(build.occurrences(_kept(s, d).join(brands, "prod_id"), "brand"))


def _brands_sql(gap: str) -> str:
    """Levels 1 to 4 of single-item elements, and pairs of one element; SQL fails if those could go on."""
    occ = OCC.replace("prod_descr AS item", "p_brand AS item").replace(
        "basket_id, p_brand", "kept.basket_id, p_brand"
    )
    occ = occ.replace("qta FROM kept GROUP BY 1, 2, 3", "qta FROM kept JOIN part ON prod_id = CAST(p_partkey AS VARCHAR) GROUP BY 1, 2, 3")
    least = f"HAVING count(*) >= {BRAND_SUP} * (SELECT n FROM nseq)"
    return f""", {occ}, {PAIR},
f1 AS (SELECT item, count(*) AS c FROM ends GROUP BY 1 {least}),
m2 AS MATERIALIZED (SELECT * FROM mt WHERE {gap.format('t2 - t1')}),
f2 AS MATERIALIZED (SELECT a, b, count(*) AS n2 FROM m2 GROUP BY 1, 2 {least}),
g2 AS (SELECT x.item AS a, y.item AS b, count(DISTINCT x.seq_id) AS c FROM occ x JOIN occ y
  ON x.seq_id = y.seq_id AND x.pos = y.pos AND x.item < y.item GROUP BY 1, 2
  HAVING count(DISTINCT x.seq_id) >= {BRAND_SUP} * (SELECT n FROM nseq)),
m3 AS MATERIALIZED (SELECT m.seq_id, m.a, m.b, o.item AS c, m.p2, m.t2, min(o.pos) AS p3, min(o.ts) AS t3
  FROM m2 m JOIN f2 USING (a, b) JOIN occ o ON o.seq_id = m.seq_id AND o.pos > m.p2
  JOIN f2 n ON n.a = m.b AND n.b = o.item GROUP BY ALL),
k3 AS MATERIALIZED (SELECT * FROM m3 WHERE {gap.format('t3 - t2')}),
f3 AS MATERIALIZED (SELECT a, b, c, count(*) AS n3 FROM k3 GROUP BY 1, 2, 3 {least}),
m4 AS (SELECT m.seq_id, m.a, m.b, m.c, o.item AS d, m.t3, min(o.ts) AS t4
  FROM k3 m JOIN f3 USING (a, b, c) JOIN occ o ON o.seq_id = m.seq_id AND o.pos > m.p3
  JOIN f3 n ON n.a = m.b AND n.b = m.c AND n.c = o.item GROUP BY ALL),
f4 AS (SELECT a, b, c, d, count(*) AS n4 FROM m4 WHERE {gap.format('t4 - t3')} GROUP BY 1, 2, 3, 4 {least}),
mined AS (SELECT '[' || item || ']' AS pattern_text, 1 AS n_items, c AS support_count FROM f1
  UNION ALL SELECT '[' || a || '][' || b || ']', 2, n2 FROM f2
  UNION ALL SELECT '[' || a || '][' || b || '][' || c || ']', 3, n3 FROM f3
  UNION ALL SELECT '[' || a || '][' || b || '][' || c || '][' || d || ']', 4, n4 FROM f4)
SELECT pattern_text, CAST(n_items AS INT) AS n_items, support_count FROM mined
WHERE CASE WHEN EXISTS (FROM g2) THEN error('elements of two items occur') ELSE true END"""


for _name, _kw, _gap in (
    ("untimed", {}, "true OR {} IS NULL"),
    ("min_gap", {"min_gap": timedelta(days=30)}, "{} >= INTERVAL 30 DAY"),
    ("max_gap", {"max_gap": timedelta(days=1700)}, "{} <= INTERVAL 1700 DAY"),
):
    _add(
        f"gsp_brands_{_name}",
        lambda s, d, kw=_kw: _text(
            mining.gsp(_brand_occ(s, d), BRAND_SUP, mining.TimeLimits(**kw)), "n_items", "support_count"
        ),
        with_lines(_brands_sql(_gap)),
    )


def _pair_supports(s, d):
    occ = _occ(s, d)
    return mining.support(mining.pair_counts(occ), occ)


_add(
    "pattern_support",
    lambda s, d: _text(_pair_supports(s, d), "support_count", mining.rnd("support", 6).alias("support")),
    with_lines(
        f""", {OCC}, {ENDS}, c AS (SELECT '[' || a.item || '][' || b.item || ']' AS pattern_text, count(*) AS support_count
FROM ends a JOIN ends b ON a.seq_id = b.seq_id AND a.lo < b.hi GROUP BY a.item, b.item
UNION ALL SELECT '[' || x.item || ',' || y.item || ']', count(DISTINCT x.seq_id) FROM occ x JOIN occ y
ON x.seq_id = y.seq_id AND x.pos = y.pos AND x.item < y.item GROUP BY x.item, y.item)
SELECT pattern_text, support_count, {rnd('support_count / CAST((SELECT n FROM nseq) AS DOUBLE)', 6)} AS support FROM c"""
    ),
)


def _pairs(s, d):
    """Frequent two-item patterns and the occurrences they come from."""
    occ = _occ(s, d)
    return stable(mining.gsp(occ, MIN_SUP)), occ


PAIRS_SQL = f"""{PAIR},
f2 AS MATERIALIZED (SELECT a, b FROM mt GROUP BY 1, 2 HAVING count(*) >= {MIN_SUP} * (SELECT n FROM nseq)),
gp AS (SELECT '[' || a || '][' || b || ']' AS pattern_text, a, b, seq_id, p1, p2, t1, t2,
  CAST(floor(epoch(t2 - t1) / 86400) AS BIGINT) AS gap_days FROM mt JOIN f2 USING (a, b))"""


def _gaps(s, d):
    found, occ = _pairs(s, d)
    return report.pattern_gaps(found, occ), occ


_add(
    "pattern_gaps",
    lambda s, d: _text(_gaps(s, d)[0], "seq_id", "gap_days"),
    with_lines(f", {OCC}, {PAIRS_SQL} SELECT pattern_text, seq_id, gap_days FROM gp"),
)


def _gap_distribution(s, d):
    gaps, occ = _gaps(s, d)
    return report.gap_distribution(stable(gaps), mining.n_sequences(occ))


_G = "CAST(gap_days AS DOUBLE)"
_add(
    "gap_distribution",
    _gap_distribution,
    with_lines(
        f""", {OCC}, {PAIRS_SQL} SELECT pattern_text, count(*) AS n, {rnd(f'avg({_G})', 4)} AS mean,
  {rnd(f'stddev_samp({_G})', 4)} AS std, min({_G}) AS min, {rnd(f'quantile_cont({_G}, 0.25)', 4)} AS q1,
  {rnd(f'quantile_cont({_G}, 0.5)', 4)} AS median, {rnd(f'quantile_cont({_G}, 0.75)', 4)} AS q3, max({_G}) AS max,
  {rnd('count(*) / CAST((SELECT n FROM nseq) AS DOUBLE)', 4)} AS matched_share FROM gp GROUP BY 1"""
    ),
)
_add(
    "gap_histogram",
    lambda s, d: report.gap_histogram(stable(_gaps(s, d)[0])),
    with_lines(
        f""", {OCC}, {PAIRS_SQL}, e AS (SELECT pattern_text, min({_G}) AS lo, max({_G}) AS hi FROM gp GROUP BY 1),
c AS (SELECT pattern_text, coalesce(least(CAST(floor(({_G} - lo) / nullif(hi - lo, 0.0) * CAST(20 AS DOUBLE)) AS INT) + 1, 20), 1) AS bin,
  count(*) AS n FROM gp JOIN e USING (pattern_text) GROUP BY 1, 2)
SELECT pattern_text, CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(1, 21)) AS bin) g
LEFT JOIN c USING (pattern_text, bin)"""
    ),
)


def _mean_quantity(s, d, order, divisor):
    found, _ = _pairs(s, d)
    out = report.pattern_mean_quantity(found, _occ(s, d, order), divisor)
    return _text(out, "element", "item", "total", "mean_qta")


def _mean_sql(order: str, mean: str) -> str:
    # the pairs come from the time order, the matches from the given one
    return f""", {OCC}, {PAIRS_SQL}, fp AS (SELECT DISTINCT pattern_text, a, b FROM gp),
pl2 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY {order}) - 1 AS pos2 FROM place),
occ2 AS MATERIALIZED (SELECT occ.seq_id, pos2 AS pos, item, qta FROM occ JOIN pl USING (seq_id, pos) JOIN pl2 USING (seq_id, basket_id)),
en2 AS (SELECT seq_id, item, min(pos) AS lo FROM occ2 GROUP BY 1, 2),
m2 AS (SELECT pattern_text, a, b, e.seq_id, e.lo AS p1, min(o.pos) AS p2 FROM fp JOIN en2 e ON e.item = a
  JOIN occ2 o ON o.seq_id = e.seq_id AND o.item = b AND o.pos > e.lo GROUP BY ALL),
f1 AS (SELECT item FROM ends GROUP BY 1 HAVING count(*) >= {MIN_SUP} * (SELECT n FROM nseq)),
el AS (SELECT '[' || item || ']' AS pattern_text, 0 AS element, item, seq_id, lo AS pos FROM en2 SEMI JOIN f1 USING (item)
  UNION ALL SELECT pattern_text, 0, a, seq_id, p1 FROM m2
  UNION ALL SELECT pattern_text, 1, b, seq_id, p2 FROM m2)
SELECT pattern_text, CAST(element AS INT) AS element, item, CAST(sum(qta) AS BIGINT) AS total, {mean} AS mean_qta
FROM el JOIN occ2 USING (seq_id, pos, item) GROUP BY 1, 2, 3"""


_add(
    "pattern_mean_quantity",
    lambda s, d: _mean_quantity(s, d, "time", "matched"),
    with_lines(_mean_sql("ts, basket_id", rnd("CAST(sum(qta) AS DOUBLE) / count(*)", 4))),
)
_NSEQ = "CAST((SELECT n FROM nseq) AS DOUBLE)"
_add(
    "pattern_mean_quantity_rounded_support",
    lambda s, d: _mean_quantity(s, d, "basket", "rounded_support"),
    with_lines(
        _mean_sql("basket_id", rnd(f"CAST(sum(qta) AS DOUBLE) / ({rnd(f'count(*) / {_NSEQ}', 2)} * {_NSEQ})", 0))
    ),
)
_add(
    "pattern_length_distribution",
    lambda s, d: report.pattern_length_distribution(_gsp(s, d)),
    with_lines(
        f""", {OCC}, {_mined_sql(MIN_SUP)}, rp AS (SELECT 2 AS n_items, count(*) AS r FROM f2 WHERE a = b)
SELECT CAST(n_items AS INT) AS n_items, count(*) AS n_patterns, coalesce(max(r), 0) AS n_with_repeats
FROM mined LEFT JOIN rp USING (n_items) GROUP BY 1"""
    ),
)


def _described(s, d):
    rows = lines(s, d)
    occ = stable(build.occurrences(build.min_basket_customers(bought(rows), MIN_BASKETS), "country"))
    found = mining.pair_counts(occ)
    out = report.describe_patterns(found, rows.select(F.col("country").alias("prod_id"), F.col("prod_descr")))
    return out.select(
        P.text(F.col("pattern")).alias("pattern_text"), P.text(F.col("described")).alias("described_text"), "support_count"
    )


_add(
    "describe_patterns",
    _described,
    with_lines(
        f""", {OCC.replace('prod_descr AS item', 'country AS item')}, {ENDS},
nm AS (SELECT country AS item, min(prod_descr) AS descr FROM lines GROUP BY 1),
c AS (SELECT a.item AS a, b.item AS b, count(*) AS support_count FROM ends a JOIN ends b ON a.seq_id = b.seq_id AND a.lo < b.hi GROUP BY 1, 2)
SELECT '[' || a || '][' || b || ']' AS pattern_text, '[' || x.descr || '][' || y.descr || ']' AS described_text, support_count
FROM c JOIN nm x ON x.item = a JOIN nm y ON y.item = b"""
    ),
)


SWEEP_SUP = 0.1


def _sweep(s, d, param, days):
    return mining.constraint_sweep(_occ(s, d), param, [timedelta(days=x) for x in days], SWEEP_SUP)


for _param, _days, _expr in (
    ("min_gap", list(range(33, -1, -3)), "t2 - t1 >= v * INTERVAL 1 DAY"),
    ("max_gap", [7 * w for w in range(40, 280, 20)], "t2 - t1 <= v * INTERVAL 1 DAY"),
    ("max_span", [7 * w for w in range(40, 320, 20)], "t2 - t1 <= v * INTERVAL 1 DAY"),
):
    _add(
        f"constraint_sweep_{_param}",
        lambda s, d, p=_param, days=_days: _sweep(s, d, p, days),
        with_lines(
            f""", {OCC}, {PAIR}, vs AS (SELECT unnest({_days!r}) AS v),
k AS (SELECT v, a, b FROM mt CROSS JOIN vs WHERE v = 0 OR {_expr} GROUP BY 1, 2, 3
  HAVING count(*) >= {SWEEP_SUP} * (SELECT n FROM nseq))
SELECT CAST(vs.v AS INT) AS value_days, count(k.a) AS n_patterns FROM vs LEFT JOIN k ON k.v = vs.v GROUP BY 1"""
        ),
    )
SUPS, BASKETS = (0.4, 0.2, 0.15), (12, 10)


def _sweep_sql(n: int) -> str:
    sizes = ", ".join(
        f"{{'s': {s}, 'p': count(*) FILTER (x >= {s}), 't': count(*) FILTER (x >= {s} AND n_items >= 2),"
        f" 'r': count(*) FILTER (x >= {s} AND again)}}"
        for s in SUPS
    )
    sql = f""", {_occ_sql(n=n)}, {_mined_sql(min(SUPS))},
sp AS (SELECT n_items, c / CAST((SELECT n FROM nseq) AS DOUBLE) AS x,
  len(list_distinct(regexp_extract_all(pattern_text, '[^\\[\\],]+'))) < n_items AS again FROM mined)
SELECT {n} AS min_baskets, unnest([{sizes}]) AS z FROM sp"""
    return f"SELECT * FROM ({with_lines(sql)})"


_add(
    "mining_sweep",
    lambda s, d: mining.mining_sweep(
        bought(lines(s, d)), min_sups=SUPS, min_baskets=BASKETS, item="prod_descr"
    ).drop("seconds"),
    f"""SELECT CAST(min_baskets AS INT) AS min_baskets, CAST(z.s AS DOUBLE) AS min_sup, z.p AS n_patterns,
  z.t AS n_two_or_more, z.r AS n_with_repeats FROM ({' UNION ALL '.join(map(_sweep_sql, BASKETS))})""",
)
