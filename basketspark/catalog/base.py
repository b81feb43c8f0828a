"""Shared pieces of the check SQL."""

from __future__ import annotations

LINES = """
lines AS (
  SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS prod_id, upper(p_name) AS prod_descr,
    CAST(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 100) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0))
      * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS sale,
    CAST(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT) END AS BIGINT) AS qta,
    o_orderdate AS purchase_ts, o_custkey AS customer_id, n_name AS country
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

RAW = (
    LINES
    + """,
raw AS (
  SELECT CASE WHEN qta < 0 THEN 'C' ELSE '' END || CAST(basket_id AS VARCHAR) AS basket_id, purchase_ts AS basket_ts,
    replace(CAST(sale AS VARCHAR), '.', ',') AS sale, CAST(customer_id AS DOUBLE) AS customer_id, country, prod_id,
    ' ' || lower(prod_descr) || ' ' AS prod_descr, CAST(qta AS INT) AS qta
  FROM lines
)"""
)


def rnd(x: str, digits: int) -> str:
    """Half-up rounding, bit for bit what the operators use."""
    scale = f"{float(10**digits)!r}"
    return f"(floor(CAST({x} AS DOUBLE) * CAST({scale} AS DOUBLE) + 0.5) / CAST({scale} AS DOUBLE))"


def quantile(rel: str, x: str, q: float) -> str:
    """Scalar subquery: linear-interpolated quantile over a relation."""
    return f"(SELECT quantile_cont(CAST({x} AS DOUBLE), {q}) FROM {rel})"


def with_lines(sql: str, raw: bool = False) -> str:
    return f"WITH {RAW if raw else LINES}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"


def inner_edges(x: str, q: int) -> str:
    """Aggregate: distinct ascending equal-frequency edges without the outer two."""
    qs = ", ".join(repr(i / q) for i in range(q + 1))
    edges = f"list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), [{qs}])))"
    return f"({edges})[2:-2]"


ENTROPY = "greatest(log2(sum(m)) - sum(m * log2(m)) / sum(m), 0.0)"

PROFILE = f"""
pos AS (SELECT * FROM lines WHERE qta > 0),
gmax AS (SELECT max(purchase_ts) AS t FROM lines),
bk AS (SELECT customer_id, basket_id, sum(qta) AS items, sum(qta * sale) AS amount, min(purchase_ts) AS f,
  max(purchase_ts) AS l FROM pos GROUP BY 1, 2),
bf AS (SELECT customer_id, CAST(floor(epoch(max(t) - max(l)) / 86400) AS BIGINT) AS recency, count(*) AS frequency,
  {rnd('sum(amount)', 2)} AS monetary, CAST(sum(items) AS BIGINT) AS tot_items, CAST(max(items) AS BIGINT) AS max_items,
  CAST(sum(items) // count(*) AS BIGINT) AS mean_basket_items, {rnd('max(amount)', 2)} AS max_sale,
  {rnd('CAST(sum(amount) AS DOUBLE) / count(*)', 2)} AS mean_basket_sale,
  {rnd('floor(epoch(max(l) - min(f)) / 86400) / count(*)', 2)} AS purchasing_freq
  FROM bk, gmax GROUP BY 1),
cp AS (SELECT customer_id, prod_id, CAST(sum(qta) AS DOUBLE) AS m FROM pos GROUP BY 1, 2),
pf AS (SELECT customer_id, count(*) AS unique_items, {rnd(ENTROPY, 2)} AS e_prods FROM cp GROUP BY 1),
ip AS (SELECT customer_id, prod_id AS item_pref FROM cp
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY m DESC, prod_id) = 1),
mi AS (SELECT customer_id, {rnd('CAST(sum(sale) AS DOUBLE) / count(*)', 2)} AS mean_item_sale
  FROM (SELECT DISTINCT customer_id, sale FROM pos) GROUP BY 1),
se AS (SELECT {inner_edges('sale', 10)} AS e FROM lines),
sb AS (SELECT customer_id, len(list_filter(e, lambda b: b < CAST(sale AS DOUBLE))) AS bin, CAST(count(*) AS DOUBLE) AS m
  FROM pos, se GROUP BY 1, 2),
es AS (SELECT customer_id, {rnd(ENTROPY, 2)} AS e_sale FROM sb GROUP BY 1),
ob AS (SELECT basket_id, max(customer_id) AS customer_id, sum(qta * sale) AS amount FROM pos GROUP BY 1),
be AS (SELECT {inner_edges('amount', 3)} AS e FROM ob),
bb AS (SELECT customer_id, len(list_filter(e, lambda b: b < CAST(amount AS DOUBLE))) AS bin, CAST(count(*) AS DOUBLE) AS m
  FROM ob, be GROUP BY 1, 2),
eb AS (SELECT customer_id, {rnd(ENTROPY, 2)} AS e_baskets FROM bb GROUP BY 1),
dy AS (SELECT DISTINCT customer_id, CAST(purchase_ts AS DATE) AS day FROM pos),
gp AS (SELECT customer_id, day - lag(day) OVER (PARTITION BY customer_id ORDER BY day) AS gap FROM dy),
wk AS (SELECT customer_id, ceil(gap / 7.0) AS week, CAST(count(*) AS DOUBLE) AS m FROM gp WHERE gap IS NOT NULL GROUP BY 1, 2),
ei AS (SELECT customer_id, {rnd(ENTROPY, 2)} AS e_intervals FROM wk GROUP BY 1),
tm AS (SELECT DISTINCT customer_id, purchase_ts FROM pos),
cal AS (SELECT customer_id, CAST(sum(isodow(purchase_ts) - 1) // count(*) AS BIGINT) AS weekday_pref,
  CAST(sum(CAST(ceil(day(purchase_ts) / 7.0) AS BIGINT)) // count(*) AS BIGINT) AS weekmonth_pref FROM tm GROUP BY 1),
mc AS (SELECT customer_id, country AS main_country FROM pos GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(DISTINCT basket_id) DESC, country) = 1),
rt AS (SELECT customer_id, -sum(qta) AS returned FROM lines
  WHERE qta < 0 AND prod_id NOT IN ('M', 'D', 'BANK CHARGES') GROUP BY 1),
profile AS (SELECT customer_id, recency, frequency, monetary, tot_items, max_items, mean_basket_items, unique_items,
  coalesce({rnd('CAST(returned AS DOUBLE) / tot_items * 100.0', 2)}, 0.0) AS p_return, max_sale, mean_basket_sale,
  mean_item_sale, e_prods, e_sale, coalesce(e_baskets, 0.0) AS e_baskets, coalesce(e_intervals, 0.0) AS e_intervals,
  purchasing_freq, weekday_pref, weekmonth_pref, item_pref, main_country
  FROM bf JOIN pf USING (customer_id) JOIN ip USING (customer_id) JOIN mi USING (customer_id) JOIN es USING (customer_id)
  LEFT JOIN eb USING (customer_id) LEFT JOIN ei USING (customer_id) JOIN cal USING (customer_id)
  JOIN mc USING (customer_id) LEFT JOIN rt USING (customer_id))"""


def with_profile(sql: str) -> str:
    """``sql`` after the profile tables; starts with a comma when it defines more of them."""
    return f"WITH {LINES},{PROFILE}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
