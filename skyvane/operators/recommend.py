"""Advice per user from preferences and the latest reading at the user's location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.functions import labels, nested
from skyvane.operators import joins
from skyvane.operators.rules import HEAT_LIMIT, WIND_LIMIT


def with_preferences(users: DataFrame) -> DataFrame:
    """Add the normalised preference struct as ``wishes``."""
    return (
        users.withColumn("_stored", nested.stored_preferences(F.col("preferences")))
        .withColumn("wishes", nested.preferences(F.col("_stored")))
        .drop("_stored")
    )


def recommendations(users: DataFrame, latest: DataFrame) -> DataFrame:
    matched = joins.users_with_latest(
        with_preferences(users), latest.select("location", "temperature")
    )
    return matched.select(
        "user_id",
        "username",
        "location",
        "temperature",
        F.col("wishes.temperature_min").alias("temperature_min"),
        F.col("wishes.temperature_max").alias("temperature_max"),
        labels.recommendation(
            F.col("temperature"),
            F.col("wishes.temperature_min"),
            F.col("wishes.temperature_max"),
            F.col("wishes.preferred_activities"),
        ).alias("recommendation"),
    )


def wished_activity_counts(users: DataFrame) -> DataFrame:
    """How many users name each activity among their preferred ones."""
    return (
        with_preferences(users)
        .select(F.explode("wishes.preferred_activities").alias("activity"))
        .groupBy("activity")
        .agg(F.count("*").alias("n_users"))
    )


def avoidances(users: DataFrame, latest: DataFrame) -> DataFrame:
    """Which of a user's avoided conditions the latest reading meets."""
    matched = joins.users_with_latest(
        with_preferences(users),
        latest.select("location", "temperature", "wind_speed", "weather_condition"),
    )
    rainy = labels.condition_category(F.col("weather_condition")).isin("rainy", "stormy")

    def met(flag: str, condition: Column) -> Column:
        return F.coalesce(F.col(f"wishes.{flag}") & condition, F.lit(False))

    return matched.select(
        "user_id",
        "location",
        met("avoid_rain", rainy).alias("rain_to_avoid"),
        met("avoid_extreme_heat", F.col("temperature") > HEAT_LIMIT).alias("heat_to_avoid"),
        met("avoid_extreme_wind", F.col("wind_speed") > WIND_LIMIT).alias("wind_to_avoid"),
    )


def activity_suitability(activities: DataFrame) -> DataFrame:
    """Mean satisfaction per activity and weather condition."""
    return activities.groupBy("activity_type", "weather_condition").agg(
        F.count("*").alias("n"),
        F.avg("satisfaction_rating").alias("mean_rating"),
        F.avg("duration_minutes").alias("mean_minutes"),
    )
