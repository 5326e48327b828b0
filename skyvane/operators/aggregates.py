"""Counts per user, totals and column statistics. All aggregate before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions.labels import model_status
from skyvane.functions.numbers import or_zero


def activity_counts(activities: DataFrame) -> DataFrame:
    return activities.groupBy("user_id").agg(F.count("activity_id").alias("activity_count"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """All alerts and active ones, side by side."""
    return alerts.groupBy("user_id").agg(
        F.count("alert_id").alias("alert_count"),
        F.count_if("is_active").alias("active_alert_count"),
    )


def users_with_counts(users: DataFrame, activities: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per user with both counts.

    Each child is counted by user before the join, so two alerts and three activities stay
    2 and 3, and a user with very many of either is reduced on the map side.
    """
    counted = users.join(activity_counts(activities), "user_id", "left").join(
        alert_counts(alerts), "user_id", "left"
    )
    names = ("activity_count", "alert_count", "active_alert_count")
    return counted.withColumns({name: or_zero(F.col(name)) for name in names})


def locations_of(users: DataFrame) -> DataFrame:
    return users.select("location").distinct()


def summary(
    users: DataFrame, activities: DataFrame, alerts: DataFrame, model_state: DataFrame
) -> DataFrame:
    """The one-row dashboard summary; each total is its own scalar subquery. ``model_state`` is
    one row that says whether a model ``is_trained``."""
    one_row = users.sparkSession.range(1)
    return one_row.select(
        users.agg(F.count("*")).scalar().alias("total_users"),
        alerts.agg(F.count_if("is_active")).scalar().alias("active_alerts"),
        activities.agg(F.count("*")).scalar().alias("total_activities"),
        model_status(model_state.select("is_trained").scalar()).alias("model_status"),
    )


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation per column, one row per column, one pass."""
    parts = [
        part
        for column in columns
        for part in (
            F.avg(column).alias(f"{column}_mean"),
            F.stddev_pop(column).alias(f"{column}_std"),
        )
    ]
    entries = [
        F.struct(
            F.lit(column).alias("feature"),
            F.col(f"{column}_mean").alias("mean"),
            F.col(f"{column}_std").alias("std"),
        )
        for column in columns
    ]
    return df.agg(*parts).select(F.inline(F.array(*entries)))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows, R², mean absolute and root mean squared error of one prediction column."""
    error = F.col(label) - F.col(prediction)
    return df.agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(label))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
