"""Bands, categories, tiers and texts derived from readings and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyvane.functions.nested import first_or, looked_up

# Condition text -> category.
CONDITION_CATEGORIES = {
    "Clear": "sunny",
    "Clouds": "cloudy",
    "Rain": "rainy",
    "Thunderstorm": "stormy",
    "Snow": "cold",
    "Sunny": "sunny",
    "Cloudy": "cloudy",
    "Rainy": "rainy",
    "Stormy": "stormy",
}
DEFAULT_CATEGORY = "cloudy"

# Severity -> tier.
SEVERITY_TIERS = {"Critical": "danger", "High": "danger", "Medium": "warning"}
DEFAULT_TIER = "info"

# Recommendation texts.
TOO_HOT = "Stay indoors, temperature is high"
TOO_COLD = "Wear warm clothing"
PERFECT_FOR = "Perfect weather for "
DEFAULT_ACTIVITY = "outdoor activities"


def temperature_band(temperature: Column) -> Column:
    return (
        F.when(temperature < 10, "cold")
        .when(temperature < 20, "mild")
        .when(temperature < 30, "warm")
        .when(temperature.isNotNull(), "hot")
    )


def condition_category(condition: Column) -> Column:
    return looked_up(CONDITION_CATEGORIES, condition, DEFAULT_CATEGORY)


def severity_tier(severity: Column) -> Column:
    return looked_up(SEVERITY_TIERS, F.initcap(severity), DEFAULT_TIER)


def recommendation(
    temperature: Column, low: Column, high: Column, preferred_activities: Column
) -> Column:
    """Advice for one user; null without a reading or without bounds."""
    known = temperature.isNotNull() & low.isNotNull() & high.isNotNull()
    return (
        F.when(known & (temperature > high), TOO_HOT)
        .when(known & (temperature < low), TOO_COLD)
        .when(
            known,
            F.concat(F.lit(PERFECT_FOR), first_or(preferred_activities, DEFAULT_ACTIVITY)),
        )
    )


def model_status(is_trained: Column) -> Column:
    return F.when(is_trained, "Trained").otherwise("Training")
