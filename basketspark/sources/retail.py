"""The order tables seen as supermarket purchase lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stored

LINE_COLUMNS = ("basket_id", "prod_id", "prod_descr", "sale", "qta", "purchase_ts", "customer_id", "country")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Clean-typed purchase lines; returned lines carry a negative quantity.

    ``columns`` names the ones to return, all by default. Only the tables they come from are joined, which gives
    the same lines as all of them because every line has its part, order, customer and nation.

    The unit price is integer arithmetic (four decimals, truncated), so sums stay exact.
    """
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    od = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, folder, "nation").select("n_nationkey", "n_name")
    pa = table(spark, folder, "part").select("p_partkey", "p_name")
    units = F.col("l_quantity").cast("int")
    wanted = set(columns or LINE_COLUMNS)
    joined = li
    if "prod_descr" in wanted:
        joined = joined.join(pa, F.col("l_partkey") == F.col("p_partkey"))
    if wanted & {"purchase_ts", "customer_id", "country"}:
        joined = joined.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    if "country" in wanted:
        joined = joined.join(cu, F.col("o_custkey") == F.col("c_custkey"))
        joined = joined.join(na, F.col("c_nationkey") == F.col("n_nationkey"))
    made = dict(
        zip(
            LINE_COLUMNS,
            (
                F.col("l_orderkey").alias("basket_id"),
                F.col("l_partkey").cast("string").alias("prod_id"),
                F.upper("p_name").alias("prod_descr"),
                (
                    F.expr("cast((cast(round(l_extendedprice * 100) as bigint) * 100) div cast(l_quantity as bigint) as decimal(18,0))")
                    * F.expr("cast(0.0001 as decimal(5,4))")
                )
                .cast("decimal(18,4)")
                .alias("sale"),
                F.when(F.col("l_returnflag") == "R", -units).otherwise(units).cast("long").alias("qta"),
                F.col("o_orderdate").alias("purchase_ts"),
                F.col("o_custkey").alias("customer_id"),
                F.col("n_name").alias("country"),
            ),
            strict=True,
        )
    )
    return joined.select(*[c for name, c in made.items() if name in wanted])


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines written out once as Parquet, for work that reads them several times."""
    return stored(lines(spark, folder))


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines in export form: text price with a decimal comma, ``C`` before cancelled baskets,
    product id and description in mixed case."""
    cancelled = F.col("qta") < 0
    return lines(spark, folder).select(
        F.concat(F.when(cancelled, F.lit("C")).otherwise(F.lit("")), F.col("basket_id").cast("string")).alias(
            "basket_id"
        ),
        F.col("purchase_ts").alias("basket_ts"),
        F.regexp_replace(F.col("sale").cast("string"), r"\.", ",").alias("sale"),
        F.col("customer_id").cast("double").alias("customer_id"),
        "country",
        "prod_id",
        F.concat(F.lit(" "), F.lower("prod_descr"), F.lit(" ")).alias("prod_descr"),
        F.col("qta").cast("int").alias("qta"),
    )
