"""Calibration and banding of scores, distances and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import fixed_values as fv


def score_to_percentage(
    distance: Column,
    steepness: float = fv.SIGMOID_STEEPNESS,
    midpoint: float = fv.SIGMOID_MIDPOINT,
) -> Column:
    """Cosine distance in [0, 2] to a match percentage; null stays null."""
    curve = F.round(100.0 / (1.0 + F.exp(F.lit(steepness) * (distance - F.lit(midpoint)))), 2)
    return (
        F.when(distance.isNull(), F.lit(None).cast("double"))
        .when(distance < 0, F.lit(100.0))
        .when(distance > 2.0, F.lit(0.0))
        .otherwise(curve)
    )


def score_linear_percentage(distance: Column) -> Column:
    """The older straight-line mapping of a distance to a percentage."""
    line = F.greatest(F.lit(0.0), 100.0 - distance * 50.0)
    return F.when(distance.isNull(), F.lit(None).cast("double")).when(
        distance <= 2.0, line
    ).otherwise(F.lit(0.0))


def band_at_least(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first (highest) cut the value reaches."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in cuts:
        chain = chain.when(value >= bound, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def band_below(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first cut the value stays below."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in cuts:
        chain = chain.when(value < bound, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def match_category(percentage: Column) -> Column:
    return band_at_least(percentage, fv.CATEGORY_CUTS, fv.CATEGORY_OTHERWISE)


def score_to_strength(score: Column) -> Column:
    return band_at_least(score, fv.STRENGTH_CUTS, fv.STRENGTH_OTHERWISE)


def duration_category(milliseconds: Column) -> Column:
    return band_below(milliseconds, fv.DURATION_CUTS_MS, fv.DURATION_OTHERWISE)


def query_duration_category(milliseconds: Column) -> Column:
    return band_below(milliseconds, fv.QUERY_DURATION_CUTS_MS, fv.DURATION_OTHERWISE)
