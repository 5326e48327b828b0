"""Queries behind the dashboard and the user list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions import labels, text, times
from skyvane.operators import aggregates, topk, windows
from skyvane.sources.models import ModelRegistry
from skyvane.sources.tables import Tables

RECENT_ACTIVITIES = 5
RECENT_READINGS = 3


def summary(tables: Tables, registry: ModelRegistry) -> DataFrame:
    """Totals, and the status of the stored model."""
    return aggregates.summary(
        tables.users, tables.activities, tables.alerts, registry.is_trained()
    )


def recent_activities(tables: Tables, n: int = RECENT_ACTIVITIES) -> DataFrame:
    recent = topk.newest_with_users(
        tables.activities, tables.users, "activity_date", "activity_id", n
    )
    return recent.select(
        "activity_id",
        "username",
        "activity_type",
        "weather_condition",
        times.minute_text(F.col("activity_date")).alias("activity_minute"),
    )


def recent_readings(tables: Tables, n: int = RECENT_READINGS) -> DataFrame:
    return topk.newest(tables.weather, "recorded_at", "data_id", n).select(
        "data_id",
        "location",
        text.one_decimal(F.col("temperature"), "°C").alias("temperature_text"),
        labels.temperature_band(F.col("temperature")).alias("band"),
        "weather_condition",
        labels.condition_category(F.col("weather_condition")).alias("category"),
        "humidity",
        "wind_speed",
        times.minute_text(F.col("recorded_at")).alias("recorded_minute"),
    )


def user_list(tables: Tables) -> DataFrame:
    counted = aggregates.users_with_counts(tables.users, tables.activities, tables.alerts)
    return counted.select(
        "user_id",
        "username",
        "email",
        "location",
        "activity_count",
        F.col("active_alert_count").alias("alert_count"),
        times.date_text(F.col("created_at")).alias("member_since"),
    )


def current_reading(
    tables: Tables, location: str = "London", latest: DataFrame | None = None
) -> DataFrame:
    """The newest reading of one location, from kept latest readings where they are given."""
    if latest is not None:
        return latest.where(F.col("location") == location)
    at_place = tables.weather.where(F.col("location") == location)
    return windows.latest_per_location(at_place)
