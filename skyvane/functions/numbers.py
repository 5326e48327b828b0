"""Numeric scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a shown confidence.
CONFIDENCE_LOW = 0.6
CONFIDENCE_HIGH = 0.95


def hectopascal_scaled(pressure: Column) -> Column:
    return pressure / 100


def round_half_even(number: Column, digits: int) -> Column:
    return F.bround(number, digits)


def clamp_confidence(number: Column) -> Column:
    inside = F.least(F.lit(CONFIDENCE_HIGH), F.greatest(F.lit(CONFIDENCE_LOW), number))
    return F.when(number.isNotNull(), inside)  # without a score there is no confidence


def int_or(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def double_or(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0))
