"""Readers and writers for every hand-over table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import LABELLED, LINES, PROFILE


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated export with a header and a leading row-index column; every field is read as text."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(
        F.col("BasketID").alias("basket_id"),
        F.to_timestamp_ntz(F.col("BasketDate")).alias("basket_ts"),
        F.col("Sale").alias("sale"),
        F.col("CustomerID").cast("double").alias("customer_id"),
        F.col("CustomerCountry").alias("country"),
        F.col("ProdID").alias("prod_id"),
        F.col("ProdDescr").alias("prod_descr"),
        F.col("Qta").cast("int").alias("qta"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a stage's table; CSV keeps a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def bought(lines: DataFrame) -> DataFrame:
    """Purchases only."""
    return lines.where(F.col("qta") > 0)


class PatternStore:
    """Mining results, one partition per (min_baskets, min_sup), constraints in days as columns."""

    CONSTRAINTS = ("max_span", "min_gap", "max_gap")
    SETTINGS = (*CONSTRAINTS, "min_baskets", "min_sup", "limits")

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _tag(self, given: Mapping[str, int]) -> str:
        """Partition value of a set of constraints; 0 is a constraint, None is none."""
        return "_".join(f"{c}{given[c]}" for c in self.CONSTRAINTS if given.get(c) is not None) or "none"

    def write(
        self,
        patterns: DataFrame,
        min_baskets: int,
        min_sup: float,
        constraints: Mapping[str, int] | None = None,
    ) -> None:
        """Replace the result of this exact configuration, keeping the others."""
        given = dict(constraints or {})
        out = patterns.select(
            "pattern",
            "n_items",
            "n_elements",
            "support_count",
            "support",
            *[F.lit(given.get(c)).cast("int").alias(c) for c in self.CONSTRAINTS],
            F.lit(int(min_baskets)).alias("min_baskets"),
            F.lit(f"{min_sup:g}").alias("min_sup"),
            F.lit(self._tag(given)).alias("limits"),
        )
        # a row without a pattern stands for the configuration, so that an empty result replaces an old one
        mark = out.sparkSession.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema if f.name not in self.SETTINGS],
            *[F.lit(given.get(c)).cast("int").alias(c) for c in self.CONSTRAINTS],
            F.lit(int(min_baskets)).alias("min_baskets"),
            F.lit(f"{min_sup:g}").alias("min_sup"),
            F.lit(self._tag(given)).alias("limits"),
        )
        (
            out.unionByName(mark)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("min_baskets", "min_sup", "limits")
            .parquet(self.path)
        )

    def read(
        self, min_baskets: int, min_sup: float, constraints: Mapping[str, int] | None = None
    ) -> DataFrame:
        """One configuration, highest support first."""
        given = dict(constraints or {})
        df = self.spark.read.parquet(self.path).where(
            (F.col("min_baskets") == int(min_baskets)) & (F.col("min_sup").cast("double") == float(min_sup))
        )
        df = df.where((F.col("limits") == self._tag(given)) & F.col("pattern").isNotNull())
        return df.orderBy(F.desc("support"), F.desc("support_count"), F.col("pattern").cast("string"))

    def sweep(self, param: str, min_baskets: int, min_sup: float) -> DataFrame:
        """Number of 2- and 3-item patterns per stored value of one constraint, in numeric order."""
        others = [c for c in self.CONSTRAINTS if c != param]
        df = self.spark.read.parquet(self.path).where(
            (F.col("min_baskets") == int(min_baskets)) & (F.col("min_sup").cast("double") == float(min_sup))
        )
        df = df.where(F.col(param).isNotNull())
        for c in others:
            df = df.where(F.col(c).isNull())
        return (
            df.groupBy(F.col(param).alias("value"))
            .agg(F.count_if(F.col("n_items").isin(2, 3)).alias("n_patterns"))
            .orderBy("value")
        )


def append_run_metrics(
    spark: SparkSession,
    path: str,
    min_baskets: int,
    min_sup: float,
    seconds: float,
    patterns: DataFrame,
) -> None:
    """Append one row per mining run: parameters, time, result size, size >= 2, with repeats."""
    repeated = F.size(F.flatten("pattern")) > F.size(F.array_distinct(F.flatten("pattern")))
    row = patterns.agg(
        F.lit(int(min_baskets)).alias("min_baskets"),
        F.lit(float(min_sup)).alias("min_sup"),
        F.lit(float(seconds)).alias("seconds"),
        F.count(F.lit(1)).alias("n_patterns"),
        F.count_if(F.col("n_items") >= 2).alias("n_two_or_more"),
        F.count_if(repeated).alias("n_with_repeats"),
    )
    row.write.mode("append").parquet(path)
