"""Which alerts the readings set off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions import labels, times
from skyvane.operators import joins, rules, topk, windows
from skyvane.sources.tables import Tables


def tripped_alerts(tables: Tables, latest: DataFrame | None = None) -> DataFrame:
    """User alerts set off by the latest reading at the user's location. ``latest`` may be the
    readings that a live update keeps; else they are found in the history."""
    if latest is None:
        latest = windows.latest_per_location(tables.weather, *rules.METRICS)
    hits = rules.tripped_on_latest(tables.alerts, tables.users, latest)
    return hits.select(
        "alert_id",
        "user_id",
        "username",
        "location",
        "alert_type",
        labels.severity_tier(F.col("severity")).alias("tier"),
        "message",
        "metric",
        "value",
        "threshold",
        times.minute_text(F.col("recorded_at")).alias("recorded_minute"),
    )


def warnings(tables: Tables) -> DataFrame:
    return rules.fixed_warnings(tables.weather)


def trip_history(tables: Tables) -> DataFrame:
    return rules.trip_history(rules.placed_rules(tables.alerts, tables.users), tables.weather)


def alert_history(tables: Tables) -> DataFrame:
    """All alerts with their user, newest first."""
    named = joins.activities_with_users(tables.alerts, tables.users)
    return topk.newest(named, "created_at", "alert_id").select(
        "alert_id",
        times.minute_text(F.col("created_at")).alias("time"),
        "username",
        "alert_type",
        "severity",
        "message",
        F.when(F.col("is_active"), "active").otherwise("resolved").alias("status"),
    )
