"""Cleaning of raw purchase lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import by_group_size, exact_quantiles, one_row, scan, stable, stored

# fixed values: stock-adjustment descriptions that are not products (exact, case-sensitive)
DENIED_DESCRIPTIONS = (
    "amazon",
    "check",
    "Dotcom sales",
    "reverse 21/5/10 adjustment",
    "mouldy, thrown away.",
    "found",
    "Found",
    "label mix up",
    "samples/damages",
    "thrown away",
    "damages",
    "showroom",
    "wrongly sold as sets",
    "dotcom sold sets",
    "Amazon sold sets",
    "wrongly sold sets",
    "?sold as sets?",
    "damages/display",
    "damaged stock",
    "damages?",
    "re dotcom quick fix.",
    "sold in set?",
    "damaged",
    "Damaged",
    "Missing",
    "adjustment",
    "returned",
    "wrong code?",
    "crushed",
    "damages/credits from ASOS.",
    "mailout",
    "Not rcvd in 10/11/2010 delivery",
    "Thrown away-rusty",
    "damages/dotcom?",
    "smashed",
    "reverse previous adjustment",
    "incorrectly credited C550456 see 47",
    "Next Day Carriage",
    "wet damaged",
    "Water damaged",
    "missing",
    "sold as set on dotcom",
    "to push order througha s stock was ",
    "mix up with c",
    "came coded as 20713",
    "alan hodge cant mamage this section",
    "dotcom",
    "ebay",
    "Sold as 1 on dotcom",
    "Adjust bad debt",
    "taig adjust no stock",
    "CRUK Commission",
    "?display?",
    "taig adjust",
    "allocate stock for dotcom orders ta",
    "add stock to allocate online orders",
    "test",
    "OOPS ! adjustment",
    "Dagamed",
    "historic computer difference?....se",
    "incorrect stock entry.",
    "michel oops",
    "wrongly coded 20713",
    "wrongly coded-23343",
    "stock check",
    "Wet pallet-thrown away",
    "Sale error",
    "High Resolution Image",
    "re-adjustment",
    "Amazon",
    "Unsaleable, destroyed.",
    "dotcom sales",
    "had been put aside",
    "damages wax",
    "wet rusty",
    "amazon adjust",
    "dotcom adjust",
    "check?",
    "wet pallet",
    "???missing",
    "wet?",
    "lost??",
    "wet",
    "lost",
)

# fixed values: pseudo-products that are never matched against purchases
SPECIAL_ITEMS = ("M", "D", "BANK CHARGES")


@dataclass(frozen=True)
class CleaningLimits:
    """Outlier thresholds; the defaults are the retail study's."""

    price_floor: float = 0.01
    qta_low: int = -2000
    qta_high: int = 3500
    sale_below: float = 2200
    basket_above: float = -8000
    basket_below: float = 30000


def parse_price(df: DataFrame) -> DataFrame:
    """Decimal-comma text to an exact number; fails on text that is none."""
    return df.withColumn("sale", _converted("sale", F.regexp_replace("sale", ",", "."), "decimal(18,4)"))


def _unread(name: str, value: Column) -> Column:
    """What to report of a text that is no value; null where there is nothing to report."""
    return F.when(F.col(name).isNotNull() & value.isNull(), F.concat(F.lit(f"{name} cannot be read: "), F.col(name)))


def _converted(name: str, text: Column, kind: str) -> Column:
    value = text.try_cast(kind)
    wrong = _unread(name, value)
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast(kind)).otherwise(value)


def _price(name: str = "sale") -> Column:
    return F.regexp_replace(name, ",", ".").try_cast("decimal(18,4)")


def _basket(name: str = "basket_id") -> Column:
    return F.replace(name, F.lit("C"), F.lit("")).try_cast("long")


def require_customer(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["customer_id"]).withColumn("customer_id", F.col("customer_id").cast("long"))


def drop_denied_descriptions(df: DataFrame, denied: Sequence[str] = DENIED_DESCRIPTIONS) -> DataFrame:
    """Remove stock-adjustment rows; rows without a description stay."""
    return df.where(F.col("prod_descr").isNull() | ~F.col("prod_descr").isin(*denied))


def normalise_text(df: DataFrame) -> DataFrame:
    """Upper case; descriptions lose any white space at both ends."""
    return df.withColumns(
        {
            "prod_descr": F.upper(F.regexp_replace("prod_descr", r"^\s+|\s+$", "")),
            "prod_id": F.upper("prod_id"),
        }
    )


def price_floor(df: DataFrame, floor: float = 0.01) -> DataFrame:
    return df.where(F.col("sale") >= F.lit(str(floor)).cast("decimal(18,4)"))


def basket_to_long(df: DataFrame) -> DataFrame:
    """Basket number without the cancellation mark; fails on other ids, which would all become one basket."""
    return df.withColumn("basket_id", _converted("basket_id", F.replace("basket_id", F.lit("C"), F.lit("")), "long"))


def canonical_description(df: DataFrame, pick: str = "max") -> DataFrame:
    """One description per product where several exist: greatest text, or the longest one."""
    if pick not in ("max", "longest"):
        raise ValueError("pick must be 'max' or 'longest'")
    variants = df.where("prod_descr is not null").groupBy("prod_id", "prod_descr").agg(F.lit(1).alias("_one"))
    best = (
        F.max("prod_descr")
        if pick == "max"
        else F.max(F.struct(F.length("prod_descr"), F.col("prod_descr")))["prod_descr"]
    )
    # a product with no description counts as inconsistent too, but has nothing to offer
    chosen = (
        variants.groupBy("prod_id").agg(F.count(F.lit(1)).alias("_n"), best.alias("_best")).where("_n > 1").drop("_n")
    )
    joined = df.join(chosen, "prod_id", "left")
    return joined.withColumn("prod_descr", F.coalesce("_best", "prod_descr")).select(*df.columns)


def merge_lines(df: DataFrame) -> DataFrame:
    """One line per basket, product and price."""
    return df.groupBy("basket_id", "prod_id", "sale").agg(
        F.min("basket_ts").alias("basket_ts"),
        F.sum("qta").alias("qta"),
        F.min("customer_id").alias("customer_id"),
        F.min("country").alias("country"),
        F.min("prod_descr").alias("prod_descr"),
    )


def flag_unmatched_returns(
    df: DataFrame,
    item: str = "prod_id",
    ts: str = "basket_ts",
    exempt: Sequence[str] = SPECIAL_ITEMS,
    tie_break: Sequence[str] = ("basket_id", "prod_id", "sale"),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add ``unmatched``: the running quantity of the customer's product drops below zero here.

    The running total restarts at zero after each such row. With the plain running sum S, a restart
    happens exactly where S reaches a new minimum below zero, so two running aggregates decide it.
    """
    keys = ["customer_id", item]
    order = [ts, *[c for c in tie_break if c != item]]

    def step(part: DataFrame) -> DataFrame:
        summed = scan(part, keys, order, {"_s": ("sum", "qta")})
        lows = scan(summed, keys, order, {"_m": ("min", "_s")}, exclusive=True)
        return lows.withColumn("unmatched", F.col("_s") < F.least(F.coalesce("_m", F.lit(0)), F.lit(0))).drop(
            "_s", "_m"
        )

    special = F.coalesce(F.col("prod_id").isin(*exempt), F.lit(False))  # rows without a product are checked as one
    checked = by_group_size(df.where(~special), keys, order, step, max_group_rows)
    return checked.unionByName(df.where(special).withColumn("unmatched", F.lit(False)))


def drop_unmatched_returns(df: DataFrame, **options) -> DataFrame:
    """Keep rows that :func:`flag_unmatched_returns` does not mark."""
    return flag_unmatched_returns(df, **options).where(~F.col("unmatched")).drop("unmatched")


def iqr_outlier_mask(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Add ``is_outlier``: value outside the quartiles widened by ``k`` times their distance."""
    q = one_row(exact_quantiles(df, col, [0.25, 0.75], names=["q1", "q3"]))
    x = F.col(col).cast("double")
    iqr = F.col("_q.q3") - F.col("_q.q1")
    outside = (x < F.col("_q.q1") - k * iqr) | (x > F.col("_q.q3") + k * iqr)
    return df.withColumn("_q", q).withColumn("is_outlier", outside).drop("_q")


def iqr_sign_bounds(df: DataFrame, col: str) -> DataFrame:
    """Smallest positive and largest negative value among the non-outliers."""
    kept = iqr_outlier_mask(df, col).where(~F.col("is_outlier"))
    return kept.agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.min(F.when(F.col(col) > 0, F.col(col))).alias("min_positive"),
        F.max(F.when(F.col(col) < 0, F.col(col))).alias("max_negative"),
    )


def _outside_qta(low: int, high: int) -> Column:
    return (F.col("qta") > high) | (F.col("qta") < low)


def trim_lines(df: DataFrame, qta_low: int, qta_high: int, sale_below: float) -> DataFrame:
    """Drop lines with extreme quantities or prices."""
    return df.where(~_outside_qta(qta_low, qta_high) & (F.col("sale") < F.lit(sale_below)))


def trim_lines_report(df: DataFrame, qta_low: int, qta_high: int) -> DataFrame:
    """How many lines and customers the quantity limits touch."""
    return df.where(_outside_qta(qta_low, qta_high)).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("customer_id").alias("n_customers")
    )


def basket_costs(df: DataFrame) -> DataFrame:
    return df.groupBy("basket_id").agg(F.sum(F.col("qta") * F.col("sale")).alias("cost"))


def trim_baskets(df: DataFrame, above: float, below: float) -> DataFrame:
    """Drop every line of baskets whose total lies outside (above, below)."""
    extreme = (
        basket_costs(df)
        .where((F.col("cost") <= F.lit(above)) | (F.col("cost") >= F.lit(below)))
        .select("basket_id")
    )
    return df.join(extreme, "basket_id", "left_anti")


def trim_profiles(profile: DataFrame, tot_items_below: float = 70000, monetary_below: float = 80000) -> DataFrame:
    return profile.where((F.col("tot_items") < tot_items_below) & (F.col("monetary") < monetary_below))


def finalise_lines(df: DataFrame) -> DataFrame:
    """Final names and column order; sort where the table is written, not here."""
    return df.withColumnRenamed("basket_ts", "purchase_ts").select(
        "basket_id",
        "prod_id",
        "prod_descr",
        "sale",
        F.col("qta").cast("long").alias("qta"),
        "purchase_ts",
        "customer_id",
        "country",
    )


def clean(
    raw: DataFrame,
    limits: CleaningLimits = CleaningLimits(),
    denied: Sequence[str] = DENIED_DESCRIPTIONS,
    max_group_rows: int | None = None,
) -> DataFrame:
    """The whole chain, raw export lines to clean purchase lines.

    Prices and basket ids that cannot be read are looked for in the table that is written anyway, so that filters pass
    the conversions; any such price, or basket id of a line that the price floor keeps, is an error.
    """
    floor = F.lit(str(limits.price_floor)).cast("decimal(18,4)")
    kept = F.col("sale") >= floor
    read = (
        raw.withColumns({"_sale": _unread("sale", _price()), "sale": _price()})
        .transform(require_customer)
        .transform(lambda d: drop_denied_descriptions(d, denied))
        .transform(normalise_text)
        .withColumns({"_basket": F.when(kept, _unread("basket_id", _basket())), "basket_id": _basket()})
        .where(kept | F.col("_sale").isNotNull())
        .transform(stored)
    )
    wrong = read.select(F.coalesce("_sale", "_basket").alias("m")).where("m is not null").first()
    if wrong:
        raise ValueError(wrong["m"])
    return (
        read.drop("_sale", "_basket")
        .transform(canonical_description)
        .transform(merge_lines)
        .transform(stable)  # group sizes are looked at before the running totals
        .transform(lambda d: drop_unmatched_returns(d, max_group_rows=max_group_rows))
        .transform(lambda d: trim_lines(d, limits.qta_low, limits.qta_high, limits.sale_below))
        .transform(lambda d: trim_baskets(d, limits.basket_above, limits.basket_below))
        .transform(finalise_lines)
    )
