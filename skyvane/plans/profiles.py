"""Profiles and recommendations of all users at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.functions import labels, text, times
from skyvane.operators import aggregates, recommend, windows
from skyvane.sources.tables import Tables

PROFILE_ACTIVITIES = 10
PROFILE_READINGS = 5


def profiles(tables: Tables) -> DataFrame:
    """Long form: one row per user and item, so that a user with very many alerts is many
    rows and not one huge one.

    ``section`` is header, activity, alert or reading; ``item_id`` identifies the row,
    ``at`` orders a section newest first, ``title`` and ``detail`` are its two lines.
    """
    parts = [_headers(tables), _activities(tables), _alerts(tables), _readings(tables)]
    return reduce(DataFrame.unionByName, parts)


def _item(section: str, item_id: Column, at: Column, title: Column, detail: Column):
    return [
        F.col("user_id"),
        F.lit(section).alias("section"),
        item_id.alias("item_id"),
        at.alias("at"),
        title.alias("title"),
        detail.alias("detail"),
    ]


def _headers(tables: Tables) -> DataFrame:
    counted = aggregates.users_with_counts(tables.users, tables.activities, tables.alerts)
    wishes = recommend.with_preferences(counted)
    bounds = F.concat_ws(
        " - ",
        text.one_decimal(F.col("wishes.temperature_min"), "°C"),
        text.one_decimal(F.col("wishes.temperature_max"), "°C"),
    )
    detail = F.concat_ws(
        "; ",
        F.col("location"),
        F.col("email"),
        F.concat(F.lit("alerts "), F.col("alert_count").cast("string")),
        F.concat(F.lit("active "), F.col("active_alert_count").cast("string")),
        F.nullif(bounds, F.lit("")),
        F.nullif(F.concat_ws(",", "wishes.preferred_activities"), F.lit("")),
        F.when(F.col("wishes.avoid_rain"), "Avoid Rain"),
        F.when(F.col("wishes.avoid_extreme_heat"), "Avoid Extreme Heat"),
        F.when(F.col("wishes.avoid_extreme_wind"), "Avoid Extreme Wind"),
    )
    return wishes.select(
        *_item(
            "header",
            F.col("user_id"),
            times.date_text(F.col("created_at")),
            F.col("username"),
            detail,
        )
    )


def _activities(tables: Tables) -> DataFrame:
    newest = windows.newest_per(
        tables.activities, "user_id", "activity_date", "activity_id", PROFILE_ACTIVITIES
    )
    known = newest.join(tables.users.select("user_id"), "user_id", "left_semi")
    detail = F.concat_ws(
        "; ",
        F.col("weather_condition"),
        F.concat(F.col("duration_minutes").cast("string"), F.lit("min")),
        F.concat(F.col("satisfaction_rating").cast("string"), F.lit(" stars")),
    )
    return known.select(
        *_item(
            "activity",
            F.col("activity_id"),
            times.day_minute_text(F.col("activity_date")),
            F.col("activity_type"),
            detail,
        )
    )


def _alerts(tables: Tables) -> DataFrame:
    known = tables.alerts.join(tables.users.select("user_id"), "user_id", "left_semi")
    detail = F.concat_ws("; ", labels.severity_tier(F.col("severity")), F.col("message"))
    return known.select(
        *_item(
            "alert",
            F.col("alert_id"),
            times.date_text(F.col("created_at")),
            F.col("alert_type"),
            detail,
        )
    )


def _readings(tables: Tables) -> DataFrame:
    newest = windows.newest_per(
        tables.weather, "location", "recorded_at", "data_id", PROFILE_READINGS
    )
    placed = tables.users.select("user_id", "location").join(newest, "location")
    detail = F.concat_ws(
        "; ",
        text.one_decimal(F.col("temperature"), "°C"),
        labels.temperature_band(F.col("temperature")),
        text.with_unit(F.col("humidity").cast("int"), "%"),
        text.with_unit(F.col("wind_speed").cast("int"), " km/h"),
        text.with_unit(F.col("pressure").cast("int"), " hPa"),
    )
    return placed.select(
        *_item(
            "reading",
            F.col("data_id"),
            times.clock_text(F.col("recorded_at")),
            F.col("weather_condition"),
            detail,
        )
    )


def recommendations(tables: Tables, latest: DataFrame | None = None) -> DataFrame:
    """Of the latest readings, kept ones where they are given."""
    if latest is None:
        latest = windows.latest_per_location(tables.weather, "temperature")
    return recommend.recommendations(tables.users, latest)
