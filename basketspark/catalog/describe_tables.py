"""Quality checks, statistics and rollups over the purchase lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, rollups, stats
from ..sources.retail import lines, raw_lines, table
from .base import rnd, with_lines

QUERIES = {}
ORACLE = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


# ---- quality checks -----------------------------------------------------------------------------

_add(
    "column_overview",
    lambda s, d: quality.column_overview(lines(s, d)).select("column", "non_null"),
    with_lines(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM lines"
            for c in ["basket_id", "prod_id", "prod_descr", "sale", "qta", "purchase_ts", "customer_id", "country"]
        )
    ),
)
_add(
    "cancel_sign_check",
    lambda s, d: quality.cancel_sign_check(raw_lines(s, d)),
    with_lines(
        """SELECT count(*) FILTER (basket_id LIKE '%C%') AS cancelled,
  count(*) FILTER (basket_id LIKE '%C%' AND qta > 0) AS cancelled_positive,
  count(*) FILTER (basket_id NOT LIKE '%C%' AND qta < 0 AND customer_id IS NOT NULL) AS negative_not_cancelled
FROM raw""",
        raw=True,
    ),
)
_add(
    "match_cancellations",
    lambda s, d: quality.match_cancellations(raw_lines(s, d), attrs=["prod_descr"]),
    with_lines(
        """, b AS (
  SELECT customer_id, basket_id, count(*) AS n_lines, string_agg(prod_descr, '|' ORDER BY prod_descr) AS sig
  FROM raw GROUP BY ALL)
SELECT c.customer_id, c.basket_id, c.n_lines, count(*) AS n_matches, min(p.basket_id) AS first_match
FROM b c JOIN b p ON c.customer_id = p.customer_id AND c.sig = p.sig
WHERE c.basket_id LIKE '%C%' AND p.basket_id NOT LIKE '%C%' GROUP BY ALL""",
        raw=True,
    ),
)
_add(
    "duplicate_products",
    lambda s, d: quality.duplicate_products(
        lines(s, d)
        .withColumnsRenamed({"purchase_ts": "basket_ts"})
        # list prices have few distinct values, so repeats at one price occur
        .withColumn("sale", F.col("prod_descr"))
    ).select("basket_id", "prod_id", "prod_descr", "qta", "customer_id", "country"),
    with_lines(
        """SELECT basket_id, prod_id, prod_descr, qta, customer_id, country FROM lines
QUALIFY count(*) OVER (PARTITION BY basket_id, purchase_ts, prod_id) > 1"""
    ),
)


def _with_reversals(s, d):
    """The raw lines and, for every purchased basket, one that takes all its lines back."""
    raw = raw_lines(s, d)
    back = raw.where(~F.col("basket_id").contains("C")).withColumns(
        {"basket_id": F.concat(F.lit("C9"), "basket_id"), "qta": -F.col("qta")}
    )
    return raw.unionByName(back)


_add(
    "match_cancellations_price_quantity",
    lambda s, d: quality.match_cancellations(_with_reversals(s, d)),
    with_lines(
        """, rv AS (SELECT customer_id, basket_id, prod_id, sale, qta FROM raw UNION ALL
  SELECT customer_id, 'C9' || basket_id, prod_id, sale, -qta FROM raw WHERE basket_id NOT LIKE '%C%'),
b AS (SELECT customer_id, basket_id, count(*) AS n_lines,
    string_agg(prod_id || ':' || sale || ':' || abs(qta), '|' ORDER BY prod_id, sale, abs(qta)) AS sig FROM rv GROUP BY ALL)
SELECT c.customer_id, c.basket_id, c.n_lines, count(*) AS n_matches, min(p.basket_id) AS first_match
FROM b c JOIN b p ON c.customer_id = p.customer_id AND c.sig = p.sig
WHERE c.basket_id LIKE '%C%' AND p.basket_id NOT LIKE '%C%' GROUP BY ALL""",
        raw=True,
    ),
)
# every line twice, so that only the single price decides
_add(
    "duplicate_products_price",
    lambda s, d: quality.duplicate_products(
        lines(s, d).unionByName(lines(s, d)).withColumnsRenamed({"purchase_ts": "basket_ts"})
    ).select("basket_id", "prod_id", F.col("sale").cast("double").alias("sale"), "qta", "customer_id"),
    with_lines(
        """SELECT basket_id, prod_id, CAST(sale AS DOUBLE) AS sale, qta, customer_id FROM (FROM lines UNION ALL FROM lines)
WINDOW same AS (PARTITION BY basket_id, purchase_ts, prod_id)
QUALIFY count(*) OVER same > 1 AND min(sale) OVER same = max(sale) OVER same"""
    ),
)
_FD = {
    "basket_date": ("basket_id", "purchase_ts"),
    "basket_customer": ("basket_id", "customer_id"),
    "customer_country": ("customer_id", "country"),
    "product_description": ("prod_id", "prod_descr"),
    "description_product": ("prod_descr", "prod_id"),
    "product_price": ("prod_id", "sale"),
}
for _name, (_k, _d) in _FD.items():
    _add(
        f"fd_violations_{_name}",
        lambda s, d, k=_k, dep=_d: quality.fd_violations(lines(s, d), k, dep),
        with_lines(
            f"SELECT {_k}, count(DISTINCT {_d}) AS n_distinct FROM lines GROUP BY {_k} HAVING count(DISTINCT {_d}) <> 1"
        ),
    )
_add(
    "pair_cardinality",
    lambda s, d: quality.pair_cardinality(raw_lines(s, d), "basket_id", "customer_id"),
    with_lines(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT basket_id, customer_id FROM raw
  WHERE basket_id IS NOT NULL AND customer_id IS NOT NULL)) AS n_pairs, count(DISTINCT basket_id) AS n_keys FROM raw""",
        raw=True,
    ),
)
_add(
    "cooccurring_items",
    lambda s, d: quality.cooccurring_items(lines(s, d), "1").select("basket_id", "prod_id", "qta"),
    with_lines(
        """SELECT basket_id, prod_id, qta FROM lines
WHERE prod_id <> '1' AND basket_id IN (SELECT basket_id FROM lines WHERE prod_id = '1')"""
    ),
)
_add(
    "odd_basket_ids",
    lambda s, d: quality.odd_basket_ids(
        table(s, d, "supplier").select(F.col("s_name").alias("basket_id"))
    ),
    """SELECT DISTINCT s_name AS basket_id FROM supplier
WHERE regexp_matches(s_name, '[A-Za-z]') AND s_name NOT LIKE '%C%'""",
)
_add(
    "odd_product_ids",
    lambda s, d: quality.odd_product_ids(
        table(s, d, "part").select(F.col("p_name").alias("prod_id"), F.col("p_type").alias("prod_descr"))
    ),
    """SELECT DISTINCT p_name AS prod_id, p_type AS prod_descr FROM part
WHERE regexp_matches(p_name, '[A-Za-z]') AND NOT regexp_matches(p_name, '[0-9]')""",
)
_add(
    "odd_descriptions",
    lambda s, d: quality.odd_descriptions(raw_lines(s, d)),
    with_lines("SELECT DISTINCT prod_descr FROM raw WHERE regexp_matches(prod_descr, '[a-z]')", raw=True),
)
_add(
    "null_descriptions",
    lambda s, d: quality.null_descriptions(raw_lines(s, d)),
    with_lines("SELECT count(*) FILTER (prod_descr IS NULL) AS n_null FROM raw", raw=True),
)
_add(
    "distinct_countries",
    lambda s, d: quality.distinct_sorted(lines(s, d, "country"), "country"),
    with_lines("SELECT DISTINCT country FROM lines ORDER BY 1"),
)
_add(
    "excess_decimals",
    lambda s, d: quality.excess_decimals(raw_lines(s, d)).select("basket_id", "prod_id", "sale"),
    with_lines("SELECT basket_id, prod_id, sale FROM raw WHERE regexp_matches(sale, ',[0-9]{3,}')", raw=True),
)
_add(
    "duplicate_row_count",
    lambda s, d: quality.duplicate_row_count(lines(s, d).select("customer_id", "country", "prod_descr")),
    with_lines(
        """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM lines GROUP BY customer_id, country, prod_descr)"""
    ),
)

# ---- statistics ---------------------------------------------------------------------------------


def _describe_sql(rel: str, col: str, label: str, by: str = "", where: str = "TRUE") -> str:
    x = f"CAST({col} AS DOUBLE)"
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}'{label}' AS "column", count({x}) AS n, {rnd(f'avg({x})', 4)} AS mean,
  {rnd(f'stddev_samp({x})', 4)} AS std, min({x}) AS min, {rnd(f'quantile_cont({x}, 0.25)', 4)} AS q1,
  {rnd(f'quantile_cont({x}, 0.5)', 4)} AS median, {rnd(f'quantile_cont({x}, 0.75)', 4)} AS q3, max({x}) AS max
FROM {rel} WHERE {where}{f' GROUP BY {by}' if by else ''}"""


_add(
    "describe_lines",
    lambda s, d: stats.describe(lines(s, d, "qta", "sale"), ["qta", "sale"]),
    with_lines(_describe_sql("lines", "qta", "qta") + "\nUNION ALL\n" + _describe_sql("lines", "sale", "sale")),
)
_add(
    "describe_lines_filtered",
    lambda s, d: stats.describe(lines(s, d, "qta", "sale"), ["sale"], where=F.abs("qta") < 20),
    with_lines(_describe_sql("lines", "sale", "sale", where="abs(qta) < 20")),
)
_add(
    "describe_events_by_type",
    lambda s, d: stats.describe(table(s, d, "events"), ["value"], by=["event_type"]),
    _describe_sql("events", "value", "value", by="event_type"),
)
_add(
    "quantiles_sale",
    lambda s, d: stats.quantiles(lines(s, d, "sale"), "sale", [0.8, 0.85, 0.9, 0.95]),
    with_lines(
        "SELECT "
        + ", ".join(f"{rnd(f'quantile_cont(CAST(sale AS DOUBLE), {q})', 4)} AS p{round(q * 100)}" for q in (0.8, 0.85, 0.9, 0.95))
        + " FROM lines"
    ),
)
_add(
    "quantiles_distinct_sale",
    lambda s, d: stats.quantiles(lines(s, d, "sale"), "sale", [0.25, 0.5], distinct=True),
    with_lines(
        "SELECT "
        + ", ".join(f"{rnd(f'quantile_cont(CAST(sale AS DOUBLE), {q})', 4)} AS p{round(q * 100)}" for q in (0.25, 0.5))
        + " FROM (SELECT DISTINCT sale FROM lines)"
    ),
)
_add(
    "value_counts_quantity",
    lambda s, d: stats.value_counts(lines(s, d, "qta"), F.col("qta"), order="value"),
    with_lines("SELECT qta AS value, count(*) AS n FROM lines GROUP BY qta"),
)


def _bins(x: str, lo: str, hi: str, n: int) -> str:
    return f"""coalesce(least(CAST(floor(({x} - {lo}) / nullif({hi} - {lo}, 0.0) * CAST({n} AS DOUBLE)) AS INT) + 1, {n}), 1)"""


def _histogram_sql(rel: str, col: str, bins: int, where: str = "TRUE") -> str:
    return f"""h_x AS (SELECT CAST({col} AS DOUBLE) AS x FROM {rel} WHERE {where}),
h_b AS (SELECT min(x) AS lo, max(x) AS hi FROM h_x),
h_c AS (SELECT {_bins('x', 'lo', 'hi', bins)} AS bin, count(*) AS n FROM h_x, h_b GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, {rnd(f'lo + (g.bin - 1) * ((hi - lo) / CAST({bins} AS DOUBLE))', 4)} AS bin_low,
  {rnd(f'lo + g.bin * ((hi - lo) / CAST({bins} AS DOUBLE))', 4)} AS bin_high, coalesce(n, 0) AS n
FROM h_b, (SELECT unnest(range(1, {bins + 1})) AS bin) g LEFT JOIN h_c ON h_c.bin = g.bin"""


_add(
    "histogram_sale",
    lambda s, d: stats.histogram(lines(s, d, "sale"), "sale", 50, high=10000.0),
    with_lines("," + _histogram_sql("lines", "sale", 50, "CAST(sale AS DOUBLE) < 10000")),
)
_add(
    "histogram_quantity",
    lambda s, d: stats.histogram(lines(s, d, "qta"), "qta", 100, low=-100.0, high=100.0),
    with_lines("," + _histogram_sql("lines", "qta", 100, "qta > -100 AND qta < 100")),
)
_add(
    "kde_event_value",
    lambda s, d: stats.kde(table(s, d, "events"), "value"),
    f"""WITH p AS (SELECT min(value) AS lo, max(value) AS hi, CAST(count(value) AS DOUBLE) AS n,
  stddev_samp(value) * pow(CAST(count(value) AS DOUBLE), -0.2) AS h FROM events),
g AS (SELECT unnest(range(0, 50)) AS i),
t AS (SELECT i, lo + i * (hi - lo) / CAST(49 AS DOUBLE) AS gx, n, h FROM p, g),
d AS (SELECT i, max(gx) AS x,
  sum(exp(-((value - gx) / h) * ((value - gx) / h) / 2) / (n * h * sqrt(CAST(2 AS DOUBLE) * pi()))) AS density
  FROM t, events GROUP BY i)
SELECT CAST(i AS INT) AS point, {rnd('x', 4)} AS x, {rnd('density', 6)} AS density FROM d""",
)


def _box_sql(rel: str, col: str, by: str = "") -> str:
    x = f"CAST({col} AS DOUBLE)"
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    join = f"JOIN bx_q USING ({by})" if by else "CROSS JOIN bx_q"
    inside = "x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)"
    return f"""bx AS (SELECT {lead}{x} AS x FROM {rel}),
bx_q AS (SELECT {lead}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM bx{group})
SELECT {lead}count(*) AS n, {rnd('max(q1)', 4)} AS q1, {rnd('max(median)', 4)} AS median, {rnd('max(q3)', 4)} AS q3,
  min(x) FILTER ({inside}) AS whisker_low, max(x) FILTER ({inside}) AS whisker_high,
  count(*) FILTER (NOT ({inside})) AS n_outliers
FROM bx {join}{group}"""


_add("box_stats_sale", lambda s, d: stats.box_stats(lines(s, d, "sale"), "sale"), with_lines("," + _box_sql("lines", "sale")))
_add(
    "box_stats_quantity_by_country",
    lambda s, d: stats.box_stats(lines(s, d, "qta", "country"), "qta", by=["country"]),
    with_lines("," + _box_sql("lines", "qta", "country")),
)
_CORR = ["qta", "sale", "basket_id", "customer_id"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
_CORR_SQL = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 2)} AS r FROM lines"
    for a, b in _PAIRS
)
_add("corr_matrix", lambda s, d: stats.corr_matrix(lines(s, d), _CORR), with_lines(_CORR_SQL))
_add(
    "top_correlations",
    lambda s, d: stats.top_correlations(lines(s, d), _CORR, 3),
    with_lines(
        f"SELECT a, b, abs(r) AS abs_r FROM ({_CORR_SQL}) WHERE abs(r) <> 1 ORDER BY abs_r DESC, a, b LIMIT 3"
    ),
)
_add(
    "grid_2d_quantity_sale",
    lambda s, d: stats.grid_2d(lines(s, d), "qta", "sale", 20, colour="customer_id", where=F.abs("qta") < 75),
    with_lines(
        f""", p AS (SELECT CAST(qta AS DOUBLE) AS x, CAST(sale AS DOUBLE) AS y, CAST(customer_id AS DOUBLE) AS c
  FROM lines WHERE abs(qta) < 75),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT {_bins('x', 'x0', 'x1', 20)} AS x_bin, {_bins('y', 'y0', 'y1', 20)} AS y_bin, count(*) AS n,
  {rnd('avg(c)', 4)} AS mean_colour FROM p, b GROUP BY 1, 2"""
    ),
)

# ---- rollups ------------------------------------------------------------------------------------

_MONTHLY = """monthly AS (SELECT strftime(purchase_ts, '%Y-%m') AS month, CAST(sum(qta * sale) AS DOUBLE) AS profit,
  count(DISTINCT (purchase_ts, basket_id)) AS baskets FROM lines GROUP BY 1)"""
_COUNTRY = """countries AS (SELECT country, CAST(sum(qta * sale) AS DOUBLE) AS profit,
  count(DISTINCT basket_id) AS baskets FROM lines GROUP BY 1)"""

_add(
    "monthly_stats",
    lambda s, d: rollups.monthly_stats(lines(s, d)),
    with_lines(f", {_MONTHLY} SELECT * FROM monthly ORDER BY month"),
)
_add(
    "monthly_correlation",
    lambda s, d: rollups.rollup_correlation(rollups.monthly_stats(lines(s, d))),
    with_lines(f", {_MONTHLY} SELECT {rnd('corr(profit, CAST(baskets AS DOUBLE))', 4)} AS r FROM monthly"),
)
_add(
    "monthly_percent_of_total",
    lambda s, d: rollups.percent_of_total(rollups.monthly_stats(lines(s, d)), ["profit", "baskets"]),
    with_lines(
        f""", {_MONTHLY} SELECT month, {rnd('profit * 100.0 / (SELECT sum(profit) FROM monthly)', 4)} AS profit,
  {rnd('CAST(baskets AS DOUBLE) * 100.0 / (SELECT CAST(sum(baskets) AS DOUBLE) FROM monthly)', 4)} AS baskets
FROM monthly"""
    ),
)
_add(
    "country_stats",
    lambda s, d: rollups.country_stats(lines(s, d)),
    with_lines(f", {_COUNTRY} SELECT * FROM countries"),
)
_add(
    "country_correlation",
    lambda s, d: rollups.rollup_correlation(rollups.country_stats(lines(s, d))),
    with_lines(f", {_COUNTRY} SELECT {rnd('corr(profit, CAST(baskets AS DOUBLE))', 4)} AS r FROM countries"),
)
_add(
    "country_one_vs_rest",
    lambda s, d: rollups.one_vs_rest(
        rollups.country_stats(lines(s, d)), "country", "NATION_2", ["profit", "baskets"]
    ).select("country", rollups.rnd("profit", 2).alias("profit"), "baskets"),
    with_lines(
        f""", {_COUNTRY} SELECT CASE WHEN country = 'NATION_2' THEN country ELSE 'Others' END AS country,
  {rnd('sum(profit)', 2)} AS profit, CAST(sum(baskets) AS BIGINT) AS baskets FROM countries GROUP BY 1"""
    ),
)
_add(
    "country_fold_small",
    lambda s, d: rollups.fold_small_groups(
        rollups.country_stats(lines(s, d)), "country", "NATION_2", "baskets", ["profit", "baskets"], 600
    ).select("country", rollups.rnd("profit", 2).alias("profit"), "baskets"),
    with_lines(
        f""", {_COUNTRY} SELECT CASE WHEN baskets >= 600 THEN country ELSE 'Others' END AS country,
  {rnd('sum(profit)', 2)} AS profit, CAST(sum(baskets) AS BIGINT) AS baskets
FROM countries WHERE country <> 'NATION_2' GROUP BY 1"""
    ),
)
_ACTIVITY = """act AS (SELECT country, strftime(purchase_ts, '%Y-%m') AS month, CAST(sum(qta * sale) AS DOUBLE) AS amount
  FROM lines GROUP BY ALL),
rk AS (SELECT country, row_number() OVER (ORDER BY count(*), country) - 1 AS rank FROM act GROUP BY country)"""
_add(
    "country_activity_long",
    lambda s, d: rollups.activity_long(lines(s, d)).withColumn("rank", F.col("rank").cast("long")),
    with_lines(f", {_ACTIVITY} SELECT month, country, amount, rank FROM act JOIN rk USING (country)"),
)
_COUNTRIES = [f"NATION_{i}" for i in range(25)]  # of the given tables


def _activity_matrix(s, d):
    wide = rollups.activity_matrix(lines(s, d))
    return wide.select("month", *[F.col(c).cast("double").alias(c) for c in wide.columns[1:]])


_add(
    "country_activity_matrix",
    _activity_matrix,
    with_lines(
        f", {_ACTIVITY} SELECT month, "
        + ", ".join(f"CAST(max(rank) FILTER (country = '{c}') AS DOUBLE) AS \"{c}\"" for c in _COUNTRIES)
        + " FROM act JOIN rk USING (country) GROUP BY month"
    ),
)
for _n, _f, _o in (("purchased", "qta > 0", "DESC"), ("returned", "qta < 0", "ASC")):
    _add(
        f"top_{_n}",
        lambda s, d, n=_n: getattr(rollups, f"top_{n}")(lines(s, d, "prod_descr", "qta")),
        with_lines(
            f"""SELECT prod_descr, CAST(sum(qta) AS BIGINT) AS qta FROM lines WHERE {_f}
GROUP BY 1 ORDER BY 2 {_o}, 1 LIMIT 10"""
        ),
    )
_add(
    "distinct_products",
    lambda s, d: rollups.distinct_products(lines(s, d, "prod_id")),
    with_lines("SELECT count(DISTINCT prod_id) AS n_products FROM lines"),
)
_add(
    "word_frequency_products",
    lambda s, d: rollups.word_frequency(lines(s, d, "prod_descr")),
    with_lines(
        r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(prod_descr, '\s+')) AS word FROM lines)
WHERE word NOT IN ('', 'SET', 'OF') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
)
_add(
    "word_frequency_documents",
    lambda s, d: rollups.word_frequency(
        table(s, d, "documents").select(F.upper("text").alias("text")), "text", n=50
    ),
    r"""SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(upper(text), '[ \t\n\x0B\f\r]+')) AS word FROM documents)
WHERE word NOT IN ('', 'SET', 'OF') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
_add(
    "catalog_prices",
    lambda s, d: rollups.catalog_prices(lines(s, d, "prod_id", "sale")),
    with_lines(_describe_sql("(SELECT DISTINCT prod_id, sale FROM lines)", "sale", "sale")),
)
_add(
    "buy_return_split",
    lambda s, d: rollups.buy_return_split(lines(s, d, "qta")),
    with_lines(_describe_sql("(SELECT qta, qta > 0 AS bought FROM lines)", "qta", "qta", by="bought")),
)
_add(
    "basket_totals",
    lambda s, d: rollups.basket_totals(lines(s, d, "basket_id", "qta", "sale")),
    with_lines(
        """SELECT basket_id, CAST(sum(qta) AS BIGINT) AS qta, CAST(sum(qta * sale) AS DOUBLE) AS amount
FROM lines GROUP BY 1"""
    ),
)
