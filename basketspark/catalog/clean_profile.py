"""Cleaning steps, customer profile features, binning and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, features, profile
from ..sources.io import bought
from ..sources.retail import lines, stored_lines, raw_lines, table
from .base import inner_edges, rnd, with_lines, with_profile

QUERIES = {}
ORACLE = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


DENIED = (" red widget ", " hot gear ")
LIMITS = cleaning.CleaningLimits(
    price_floor=50.0, qta_low=-45, qta_high=48, sale_below=50000, basket_above=-500000, basket_below=1500000
)


def _merged(s, d):
    return lines(s, d).withColumnRenamed("purchase_ts", "basket_ts").transform(cleaning.merge_lines)


MERGED = """merged AS (SELECT basket_id, prod_id, sale, min(purchase_ts) AS basket_ts, CAST(sum(qta) AS BIGINT) AS qta,
  min(customer_id) AS customer_id, min(country) AS country, min(prod_descr) AS prod_descr FROM lines GROUP BY 1, 2, 3)"""

_add(
    "parse_price",
    lambda s, d: cleaning.parse_price(raw_lines(s, d)).select(
        "basket_id", "prod_id", F.col("sale").cast("double").alias("sale")
    ),
    with_lines(
        """SELECT basket_id, prod_id, CAST(TRY_CAST(replace(sale, ',', '.') AS DECIMAL(18,4)) AS DOUBLE) AS sale
FROM raw""",
        raw=True,
    ),
)
_add(
    "require_customer",
    lambda s, d: cleaning.require_customer(
        # orders of 'F' status stand in for lines without a customer
        table(s, d, "orders").select(
            "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("double")).alias("customer_id")
        )
    ),
    "SELECT o_orderkey, o_custkey AS customer_id FROM orders WHERE o_orderstatus <> 'F'",
)
_add(
    "drop_denied_descriptions",
    lambda s, d: cleaning.drop_denied_descriptions(raw_lines(s, d), DENIED).select("basket_id", "prod_id", "prod_descr"),
    with_lines(
        """SELECT basket_id, prod_id, prod_descr FROM raw
WHERE prod_descr IS NULL OR prod_descr NOT IN (' red widget ', ' hot gear ')""",
        raw=True,
    ),
)
_add(
    "normalise_text",
    lambda s, d: cleaning.normalise_text(raw_lines(s, d)).select("basket_id", "prod_id", "prod_descr"),
    with_lines("SELECT basket_id, upper(prod_id) AS prod_id, upper(trim(prod_descr)) AS prod_descr FROM raw", raw=True),
)
_add(
    "price_floor",
    lambda s, d: cleaning.price_floor(lines(s, d), 500.0).select("basket_id", "prod_id", "qta"),
    with_lines("SELECT basket_id, prod_id, qta FROM lines WHERE sale >= 500"),
)
_add(
    "basket_to_long",
    lambda s, d: cleaning.basket_to_long(raw_lines(s, d)).select("basket_id", "prod_id"),
    with_lines("SELECT CAST(replace(basket_id, 'C', '') AS BIGINT) AS basket_id, prod_id FROM raw", raw=True),
)
for _pick, _expr in (
    ("max", "max(p_name)"),
    ("longest", "arg_max(p_name, lpad(CAST(length(p_name) AS VARCHAR), 6, '0') || p_name)"),
):
    _add(
        f"canonical_description_{_pick}",
        lambda s, d, pick=_pick: cleaning.canonical_description(
            table(s, d, "part").select("p_partkey", F.col("p_brand").alias("prod_id"), F.col("p_name").alias("prod_descr")),
            pick,
        ),
        f"""SELECT p_partkey, p_brand AS prod_id, best AS prod_descr
FROM part JOIN (SELECT p_brand, {_expr} AS best FROM part GROUP BY 1) USING (p_brand)""",
    )
_add(
    "merge_lines",
    lambda s, d: _merged(s, d).withColumn("sale", F.col("sale").cast("double")),
    with_lines(f", {MERGED} SELECT * REPLACE (CAST(sale AS DOUBLE) AS sale) FROM merged"),
)


def _unmatched_sql(item: str) -> str:
    over = f"OVER (PARTITION BY customer_id, {item} ORDER BY basket_ts, basket_id, prod_id, sale ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""run AS (SELECT *, sum(qta) {over} CURRENT ROW) AS s FROM merged),
low AS (SELECT *, s < least(coalesce(min(s) {over} 1 PRECEDING), 0), 0) AS unmatched FROM run)"""


for _item in ("prod_id", "prod_descr"):
    _add(
        f"drop_unmatched_returns_{_item}",
        lambda s, d, item=_item: cleaning.drop_unmatched_returns(_merged(s, d), item=item).select(
            "basket_id", "prod_id", "qta"
        ),
        with_lines(f", {MERGED}, {_unmatched_sql(_item)} SELECT basket_id, prod_id, qta FROM low WHERE NOT unmatched"),
    )
_add(
    "iqr_outlier_mask",
    lambda s, d: cleaning.iqr_outlier_mask(lines(s, d), "sale").select("basket_id", "prod_id", "qta", "is_outlier"),
    with_lines(
        """, q AS (SELECT quantile_cont(CAST(sale AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(sale AS DOUBLE), 0.75) AS q3 FROM lines)
SELECT basket_id, prod_id, qta, CAST(sale AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST(sale AS DOUBLE) > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM lines, q"""
    ),
)
_add(
    "iqr_sign_bounds",
    lambda s, d: cleaning.iqr_sign_bounds(lines(s, d), "qta"),
    with_lines(
        """, q AS (SELECT quantile_cont(CAST(qta AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(qta AS DOUBLE), 0.75) AS q3 FROM lines)
SELECT count(*) AS n_kept, min(qta) FILTER (qta > 0) AS min_positive, max(qta) FILTER (qta < 0) AS max_negative
FROM lines, q WHERE NOT (qta < q1 - 1.5 * (q3 - q1) OR qta > q3 + 1.5 * (q3 - q1))"""
    ),
)
_add(
    "trim_lines",
    lambda s, d: cleaning.trim_lines(lines(s, d), -45, 48, 50000).select("basket_id", "prod_id", "qta"),
    with_lines("SELECT basket_id, prod_id, qta FROM lines WHERE NOT (qta > 48 OR qta < -45) AND sale < 50000"),
)
_add(
    "trim_lines_report",
    lambda s, d: cleaning.trim_lines_report(lines(s, d), -45, 48),
    with_lines(
        """SELECT count(*) AS n_lines, count(DISTINCT customer_id) AS n_customers FROM lines
WHERE qta > 48 OR qta < -45"""
    ),
)
_add(
    "trim_baskets",
    lambda s, d: cleaning.trim_baskets(lines(s, d), -500000, 1500000).select("basket_id", "prod_id", "qta"),
    with_lines(
        """SELECT basket_id, prod_id, qta FROM lines WHERE basket_id NOT IN
  (SELECT basket_id FROM lines GROUP BY 1 HAVING sum(qta * sale) <= -500000 OR sum(qta * sale) >= 1500000)"""
    ),
)
_add(
    "trim_profiles",
    lambda s, d: cleaning.trim_profiles(profile.basket_features(lines(s, d)), 800, 20000000).select(
        "customer_id", "tot_items", "monetary"
    ),
    with_lines(
        f"""SELECT customer_id, CAST(sum(qta) AS BIGINT) AS tot_items, {rnd('sum(qta * sale)', 2)} AS monetary
FROM lines WHERE qta > 0 GROUP BY 1 HAVING sum(qta) < 800 AND {rnd('sum(qta * sale)', 2)} < 20000000"""
    ),
)
_CLEAN = f"""ps AS (SELECT * REPLACE (TRY_CAST(replace(sale, ',', '.') AS DECIMAL(18,4)) AS sale,
  CAST(customer_id AS BIGINT) AS customer_id) FROM raw WHERE customer_id IS NOT NULL),
nt AS (SELECT * REPLACE (upper(trim(prod_descr)) AS prod_descr, upper(prod_id) AS prod_id,
  CAST(replace(basket_id, 'C', '') AS BIGINT) AS basket_id) FROM ps
  WHERE (prod_descr IS NULL OR prod_descr NOT IN (' red widget ', ' hot gear ')) AND sale >= 50),
cd AS (SELECT nt.* REPLACE (coalesce(best, prod_descr) AS prod_descr) FROM nt
  LEFT JOIN (SELECT prod_id, max(prod_descr) AS best FROM nt GROUP BY 1 HAVING count(DISTINCT prod_descr) > 1) USING (prod_id)),
{MERGED.replace('purchase_ts', 'basket_ts').replace('FROM lines', 'FROM cd')},
{_unmatched_sql('prod_id')},
tl AS (SELECT * FROM low WHERE NOT unmatched AND NOT (qta > 48 OR qta < -45) AND sale < 50000),
cleaned AS (SELECT basket_id, prod_id, prod_descr, CAST(sale AS DOUBLE) AS sale, qta, basket_ts AS purchase_ts,
  customer_id, country FROM tl WHERE basket_id NOT IN (SELECT basket_id FROM tl GROUP BY 1
    HAVING sum(qta * sale) <= -500000 OR sum(qta * sale) >= 1500000))"""
_add(
    "clean_lines",
    lambda s, d: cleaning.clean(raw_lines(s, d), LIMITS, DENIED).withColumn("sale", F.col("sale").cast("double")),
    with_lines(f", {_CLEAN} SELECT * FROM cleaned", raw=True),
)

# ---- profile ------------------------------------------------------------------------------------

_PARTS = {
    "profile_baskets": (
        profile.basket_features,
        "customer_id, recency, frequency, monetary, tot_items, max_items, mean_basket_items, max_sale, mean_basket_sale, purchasing_freq",
    ),
    "profile_products": (profile.product_features, "customer_id, unique_items, e_prods, item_pref"),
    "profile_mean_item_sale": (profile.price_features, "customer_id, mean_item_sale"),
    "profile_price_entropy": (profile.price_entropy, "customer_id, e_sale"),
    "profile_basket_entropy": (profile.basket_entropy, "customer_id, e_baskets"),
    "profile_interval_entropy": (profile.interval_entropy, "customer_id, e_intervals"),
    "profile_calendar": (profile.calendar_features, "customer_id, weekday_pref, weekmonth_pref"),
    "profile_main_country": (profile.main_country, "customer_id, main_country"),
    "customer_profile": (profile.customer_profile, "*"),
}
for _n, (_fn, _cols) in _PARTS.items():
    _add(_n, lambda s, d, fn=_fn: fn(stored_lines(s, d)), with_profile(f"SELECT {_cols} FROM profile"))
_add(
    "profile_returns",
    lambda s, d: profile.customer_profile(stored_lines(s, d)).select("customer_id", "p_return"),
    with_profile("SELECT customer_id, p_return FROM profile"),
)

# ---- binning and scaling ------------------------------------------------------------------------

_add(
    "qcut_sale",
    lambda s, d: features.qcut(lines(s, d), "sale", 10, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
    with_lines(
        f""", e AS (SELECT {inner_edges('sale', 10)} AS e FROM lines)
SELECT CAST(len(list_filter(e, lambda b: b < CAST(sale AS DOUBLE))) AS INT) AS bin, count(*) AS n FROM lines, e GROUP BY 1"""
    ),
)
_add(
    "qcut_part_size",
    lambda s, d: features.qcut(table(s, d, "part").select("p_partkey", "p_size"), "p_size", 7, "bin"),
    f"""WITH e AS (SELECT {inner_edges('p_size', 7)} AS e FROM part)
SELECT p_partkey, p_size, CAST(len(list_filter(e, lambda b: b < CAST(p_size AS DOUBLE))) AS INT) AS bin FROM part, e""",
)
PRICE_CATEGORY = """pc AS (SELECT quantile_cont(CAST(sale AS DOUBLE), 0.25) AS a, quantile_cont(CAST(sale AS DOUBLE), 0.5) AS b
  FROM (SELECT DISTINCT sale FROM lines)),
catlines AS (SELECT lines.*, CASE WHEN CAST(sale AS DOUBLE) < a THEN 0 WHEN CAST(sale AS DOUBLE) < b THEN 1 ELSE 2 END AS category
  FROM lines, pc)"""
_add(
    "price_category",
    lambda s, d: features.price_category(lines(s, d)).select("basket_id", "prod_id", "category"),
    with_lines(f", {PRICE_CATEGORY} SELECT basket_id, prod_id, category FROM catlines"),
)


def _rounded(df, cols, digits=6):
    return df.select("customer_id", *[features.rnd(c, digits).alias(c) for c in cols])


RFM = ["recency", "frequency", "monetary"]


def _rfm(s, d):
    return profile.basket_features(lines(s, d)).select("customer_id", *RFM)


def min_max_sql(cols, rel, lo=0.0, hi=1.0):
    def one(c):
        z = f"coalesce((CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER ()) / nullif(max(CAST({c} AS DOUBLE)) OVER () - min(CAST({c} AS DOUBLE)) OVER (), 0.0), 0.0)"
        return z if (lo, hi) == (0.0, 1.0) else f"{z} * (CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE)) + CAST({lo} AS DOUBLE)"

    return f"SELECT customer_id, {', '.join(f'{one(c)} AS {c}' for c in cols)} FROM {rel}"


def _pick(cols, digits=6):
    return "customer_id, " + ", ".join(f"{rnd(c, digits)} AS {c}" for c in cols)


_add(
    "min_max_scale",
    lambda s, d: _rounded(features.min_max_scale(_rfm(s, d), RFM), RFM),
    with_profile(f", mm AS ({min_max_sql(RFM, 'profile')}) SELECT {_pick(RFM)} FROM mm"),
)
_add(
    "min_max_scale_narrow",
    lambda s, d: _rounded(features.min_max_scale(_rfm(s, d), RFM, 0.01, 0.99), RFM),
    with_profile(f", mm AS ({min_max_sql(RFM, 'profile', 0.01, 0.99)}) SELECT {_pick(RFM)} FROM mm"),
)
_STD = ", ".join(
    f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () AS {c}" for c in RFM
)
_add(
    "standard_scale",
    lambda s, d: _rounded(features.standard_scale(_rfm(s, d), RFM), RFM),
    with_profile(f", ss AS (SELECT customer_id, {_STD} FROM profile) SELECT {_pick(RFM)} FROM ss"),
)


def _round_trip(s, d):
    base = _rfm(s, d)
    params = features.min_max_params(base, RFM)
    return _rounded(features.inverse_scale(features.min_max_scale(base, RFM, params=params), RFM, params), RFM, 2)


_add("inverse_scale", _round_trip, with_profile(f"SELECT {_pick(RFM, 2)} FROM profile"))
_add(
    "cluster_input",
    lambda s, d: features.cluster_input(
        profile.customer_profile(stored_lines(s, d)), ["tot_items", "monetary", "mean_item_sale"]
    ).select(
        "customer_id", *[features.rnd(c, 4).alias(c) for c in ("tot_items", "monetary", "mean_item_sale")]
    ),
    with_profile(
        ", ss AS (SELECT customer_id, "
        + ", ".join(
            f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () AS {c}"
            for c in ("tot_items", "monetary", "mean_item_sale")
        )
        + f" FROM profile) SELECT {_pick(['tot_items', 'monetary', 'mean_item_sale'], 4)} FROM ss"
    ),
)
_add("purchases_only", lambda s, d: bought(lines(s, d)).select("basket_id", "prod_id", "qta"), with_lines("SELECT basket_id, prod_id, qta FROM lines WHERE qta > 0"))
