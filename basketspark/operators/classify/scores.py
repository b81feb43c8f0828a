"""Classification scores from (label, prediction) rows, and curves from class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import prepared, rnd, scan
from ...functions.ordered import BLOCK


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def class_scores(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    by = list(by)
    cells = df.groupBy(*by, F.col(label).cast("int").alias("l"), F.col(pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("l").alias("class"), F.lit(1).alias("is_label")),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("is_label")),
            )
        ).alias("s"),
        "l",
        "p",
        "n",
    ).select(*by, "s.class", "s.is_label", "l", "p", "n")
    counts = sides.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_label") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("is_label") == 1) & (F.col("l") == F.col("p")), F.col("n")).otherwise(0)).alias("hits"),
    )
    precision, recall = _share(F.col("hits"), F.col("predicted")), _share(F.col("hits"), F.col("support"))
    return counts.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _share(2 * precision * recall, precision + recall).alias("f1"),
        "support",
    )


def classification_scores(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (per group)."""
    per = class_scores(df, by, label, pred)

    def weighted(c: str) -> Column:
        return rnd(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c)

    # accuracy equals the support-weighted recall
    return per.groupBy(*by).agg(
        rnd(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 6).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        F.sum("support").alias("support"),
    )


def confusion_matrix(df: DataFrame, classes: Sequence[int] = (0, 1, 2), label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row per true class, also of ``classes`` without rows, one column ``pred_c`` per predicted class."""
    wide = df.groupBy(F.col(label).cast("int").alias("label")).agg(
        *[F.count_if(F.col(pred).cast("int") == c).alias(f"pred_{c}") for c in classes]
    )
    every = df.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    return every.join(wide, "label", "full").na.fill(0)


def roc_curve(df: DataFrame, classes: Sequence[int] = (0, 1, 2), label: str = "label", scores: str = "scores") -> DataFrame:
    """One-vs-rest points per class and pooled (``micro``): (curve, threshold, fpr, tpr, area_part).

    Equal scores are counted first; the counts are accumulated from the highest score down.
    """
    own = F.explode(
        F.flatten(
            F.array(
                *[
                    F.array(
                        *[
                            F.struct(
                                F.lit(name).alias("curve"),
                                F.col(scores)[i].alias("score"),
                                (F.col(label) == c).cast("long").alias("hit"),
                            )
                            for name in (str(c), "micro")
                        ]
                    )
                    for i, c in enumerate(classes)
                ]
            )
        )
    )
    counts = (
        df.select(own.alias("s"))
        .groupBy("s.curve", "s.score")
        .agg(F.sum("s.hit").alias("pos"), F.sum(1 - F.col("s.hit")).alias("neg"))
        .withColumn("down", -F.col("score"))
    )
    blocks = prepared(counts, ["curve"], ["down"])
    cum = scan(blocks, ["curve"], ["down"], {"tp": ("sum", "pos"), "fp": ("sum", "neg")}).drop(BLOCK)
    totals = blocks.groupBy("curve").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # a class without rows, or alone, has no curve
    p, n = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("P", "N"))
    trapezoid = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / (2.0 * p * n)
    return cum.join(totals, "curve").select(
        "curve",
        F.col("score").alias("threshold"),
        (F.col("fp") / n).alias("fpr"),
        (F.col("tp") / p).alias("tpr"),
        trapezoid.alias("area_part"),
    )


def macro_curve(curve: DataFrame) -> DataFrame:
    """(fpr, tpr): mean over the class curves, each interpolated at every false-positive rate.

    Curves never fall, so the neighbouring points of a rate are running maxima and minima.
    """
    knots = (
        curve.where("curve != 'micro'")
        .groupBy("curve", "fpr")
        .agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    )
    names = knots.select("curve").distinct()
    zero = names.select("curve", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    knots = knots.unionByName(zero).groupBy("curve", "fpr").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    every = names.agg(F.collect_list("curve").alias("c")).scalar()
    grid = knots.select("fpr").distinct().withColumn("curve", F.explode(every))
    rows = grid.join(knots, ["curve", "fpr"], "left").select(
        "curve", "fpr", "low", "high", F.when(F.col("high").isNotNull(), F.col("fpr")).alias("at")
    )
    up = scan(
        prepared(rows, ["curve"], ["fpr"]), ["curve"], ["fpr"], {"x0": ("max", "at"), "y0": ("max", "high")}
    ).drop(BLOCK)
    up = up.withColumn("down", -F.col("fpr"))
    both = scan(
        prepared(up, ["curve"], ["down"]), ["curve"], ["down"], {"x1": ("min", "at"), "y1": ("min", "low")}
    ).drop(BLOCK)
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    y = F.when(F.col("at").isNotNull(), F.col("high")).otherwise(F.col("y0") + slope * (F.col("fpr") - F.col("x0")))
    return both.select("fpr", y.alias("y")).groupBy("fpr").agg(F.avg("y").alias("tpr"))


def roc_area(curve: DataFrame) -> DataFrame:
    """(curve, area) per class, ``micro`` and ``macro``."""
    per = curve.groupBy("curve").agg(rnd(F.sum("area_part"), 6).alias("area"))
    points = prepared(macro_curve(curve), [], ["fpr"])
    # the previous point has the greatest smaller rate and the greatest smaller height
    prev = scan(points, [], ["fpr"], {"x0": ("max", "fpr"), "y0": ("max", "tpr")}, exclusive=True)
    area = (F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2
    macro = prev.agg(F.lit("macro").alias("curve"), rnd(F.sum(area), 6).alias("area"))
    return per.unionByName(macro)
