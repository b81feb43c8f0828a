"""What the mined patterns look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import rnd, whole_days
from ..stats import describe
from . import pattern as P
from .mining import match_patterns, n_sequences


def pattern_length_distribution(patterns: DataFrame) -> DataFrame:
    """(n_items, n_patterns, n_with_repeats), any length."""
    return patterns.groupBy(P.n_items(F.col("pattern")).alias("n_items")).agg(
        F.count(F.lit(1)).alias("n_patterns"), F.count_if(P.has_repeats(F.col("pattern"))).alias("n_with_repeats")
    )


def pattern_mean_quantity(patterns: DataFrame, occ: DataFrame, divisor: str = "matched") -> DataFrame:
    """(pattern, element, item, total, mean_qta): quantity of each pattern item in the leftmost matches.

    ``matched`` divides by the number of matching sequences; ``rounded_support`` by the support rounded
    to two decimals times the number of sequences, rounding the result to a whole number.
    """
    matches = match_patterns(patterns, occ)
    steps = matches.select("pattern", "seq_id", F.posexplode("places").alias("element", "pos"))
    wanted = steps.withColumn("item", F.explode(F.col("pattern")[F.col("element")]))
    totals = (
        wanted.join(occ.select("seq_id", "pos", "item", "qta"), ["seq_id", "pos", "item"])
        .groupBy("pattern", "element", "item")
        .agg(F.sum("qta").alias("total"), F.count(F.lit(1)).alias("matched"))
    )
    if divisor == "matched":
        mean = rnd(F.col("total") / F.col("matched"), 4)
    elif divisor == "rounded_support":
        n = float(n_sequences(occ))
        mean = rnd(F.col("total") / (rnd(F.col("matched") / n, 2) * n), 0)
    else:
        raise ValueError("divisor must be 'matched' or 'rounded_support'")
    return totals.select("pattern", "element", "item", "total", mean.alias("mean_qta"))


def pattern_gaps(patterns: DataFrame, occ: DataFrame) -> DataFrame:
    """(pattern, seq_id, gap_days) for patterns of exactly two elements."""
    two = patterns.where(F.size("pattern") == 2)
    return match_patterns(two, occ).select(
        "pattern", "seq_id", whole_days(F.col("times")[1], F.col("times")[0]).alias("gap_days")
    )


def gap_distribution(gaps: DataFrame, n_seq: int) -> DataFrame:
    """Statistics of the gaps per pattern and the share of sequences matched."""
    named = gaps.select(P.text(F.col("pattern")).alias("pattern_text"), "gap_days")
    stats = describe(named, ["gap_days"], by=["pattern_text"]).drop("column")
    return stats.withColumn("matched_share", rnd(F.col("n") / float(n_seq), 4))


def gap_histogram(gaps: DataFrame, bins: int = 20) -> DataFrame:
    """(pattern_text, bin, n): equal-width bins between each pattern's own extremes."""
    x = gaps.select(P.text(F.col("pattern")).alias("pattern_text"), F.col("gap_days").cast("double").alias("x"))
    ends = x.groupBy("pattern_text").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * float(bins))
    at = F.coalesce(F.least(place.cast("int") + 1, F.lit(bins)), F.lit(1))
    counts = x.join(ends, "pattern_text").groupBy("pattern_text", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select("pattern_text", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counts, ["pattern_text", "bin"], "left").na.fill(0, ["n"])


def describe_patterns(patterns: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``described``: the pattern with product ids replaced by a description."""
    names = lines.groupBy(F.col("prod_id").alias("item")).agg(F.min("prod_descr").alias("descr"))
    spread = patterns.select("pattern", F.posexplode("pattern").alias("i", "element")).select(
        "pattern", "i", F.posexplode("element").alias("j", "item")
    )
    named = spread.join(names, "item", "left").withColumn("descr", F.coalesce("descr", "item"))
    elements = named.groupBy("pattern", "i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "descr"))), lambda s: s["descr"]).alias("e")
    )
    whole = elements.groupBy("pattern").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("described")
    )
    return patterns.join(whole, "pattern")
