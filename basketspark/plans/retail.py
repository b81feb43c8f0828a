"""The study's stages chained; each hand-over is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import stable, stored
from ..operators.cleaning import CleaningLimits, clean, trim_profiles
from ..operators.labels import classification_table, spending_classes
from ..operators.profile import customer_profile
from ..operators.sequences.build import min_basket_customers, occurrences
from ..operators.sequences.mining import TimeLimits, gsp
from ..sources.io import bought


def raw_to_profile(raw: DataFrame, limits: CleaningLimits = CleaningLimits()) -> tuple[DataFrame, DataFrame]:
    """(clean lines, capped customer profile)."""
    lines = stored(clean(raw, limits))
    return lines, trim_profiles(customer_profile(lines))


def profile_to_classes(profile: DataFrame, lines: DataFrame, **options) -> DataFrame:
    """Labelled table for the classifiers."""
    return classification_table(spending_classes(stored(profile), **options), lines)


def lines_to_patterns(
    lines: DataFrame, min_baskets: int, min_sup: float, limits: TimeLimits = TimeLimits(), item: str = "prod_id"
) -> DataFrame:
    """Frequent purchase sequences of customers with enough baskets."""
    occ = stable(occurrences(min_basket_customers(bought(lines), min_baskets), item))
    return gsp(occ, min_sup, limits)
