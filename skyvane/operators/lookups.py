"""Row selection on readings, users and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions import times

MINIMUM_HISTORY = 20


def of_user(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def at_location(readings: DataFrame, location: str) -> DataFrame:
    return readings.where(F.col("location") == location)


def active(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("is_active"))


def of_type(alerts: DataFrame, *types: str) -> DataFrame:
    """Alerts of the given types; forms differ in casing."""
    return alerts.where(F.initcap("alert_type").isin(*types))


def since(df: DataFrame, as_of: str, hours: int, column: str = "recorded_at") -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``; the first instant is included.

    On a table partitioned by ``recorded_date`` the same bound also prunes whole days.
    """
    start = times.minus_hours(times.instant(df, column, as_of), hours)
    if "recorded_date" in df.columns:
        df = df.where(F.col("recorded_date") >= F.to_date(start))
    return df.where(F.col(column) >= start)


def history(readings: DataFrame, location: str, hours: int, as_of: str) -> DataFrame:
    """Readings of one location and window with their calendar parts, as a bound query. On a
    table partitioned by ``recorded_date`` the window also prunes whole days."""
    start = "CAST(:as_of AS TIMESTAMP_NTZ) - make_interval(0, 0, 0, 0, :hours, 0, 0)"
    by_day = "recorded_date" in readings.columns
    days = f"AND recorded_date >= CAST({start} AS DATE)" if by_day else ""
    return readings.sparkSession.sql(
        f"""
        SELECT data_id, recorded_at, temperature, humidity, pressure, wind_speed,
               hour(recorded_at) AS hour,
               dayofweek(recorded_at) - 1 AS day_of_week,
               month(recorded_at) AS month
        FROM {{readings}}
        WHERE location = :location AND recorded_at >= {start} {days}
        """,
        args={"location": location, "as_of": as_of, "hours": hours},
        readings=readings,
    )


def with_enough_history(readings: DataFrame, minimum: int = MINIMUM_HISTORY) -> DataFrame:
    """Only readings of locations that have at least ``minimum`` of them."""
    enough = (
        readings.groupBy("location").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    )
    return readings.join(enough.select("location"), "location", "left_semi")


def not_tracked(candidates: DataFrame, tracked: DataFrame) -> DataFrame:
    return candidates.join(tracked, "location", "left_anti")
