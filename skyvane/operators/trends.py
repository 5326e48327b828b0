"""Trends over time, comparison of locations, outliers, and condition texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions.times import plus_hours
from skyvane.operators.rules import METRICS


def trend(readings: DataFrame, unit: str) -> DataFrame:
    """Mean, lowest and highest temperature per location and hour or day, and the change of
    the mean from the period before. The window runs over the aggregated periods only."""
    periods = readings.groupBy("location", F.date_trunc(unit, "recorded_at").alias("period")).agg(
        F.avg("temperature").alias("mean"),
        F.min("temperature").alias("low"),
        F.max("temperature").alias("high"),
        F.count("*").alias("n"),
    )
    before = F.lag("mean").over(Window.partitionBy("location").orderBy("period"))
    return periods.withColumn("change", F.col("mean") - before)


def comparison(readings: DataFrame, unit: str = "day") -> DataFrame:
    """Mean temperature of every location in every period, a row each."""
    return readings.groupBy(F.date_trunc(unit, "recorded_at").alias("period"), "location").agg(
        F.avg("temperature").alias("mean")
    )


def extremes(readings: DataFrame, deviations: float) -> DataFrame:
    """Readings whose temperature lies ``deviations`` or more from their location's mean of
    that day. Means come from a pre-aggregated table, so no day is gathered in one task."""
    dated = readings.withColumn("day", F.to_date("recorded_at"))
    usual = dated.groupBy("location", "day").agg(
        F.avg("temperature").alias("usual"), F.stddev_pop("temperature").alias("spread")
    )
    score = F.try_divide(F.col("temperature") - F.col("usual"), F.col("spread"))
    return (
        dated.join(usual, ["location", "day"])
        .withColumn("score", score)
        .where(F.abs("score") >= deviations)
        .select("data_id", "location", "recorded_at", "temperature", "score")
    )


def condition_parts(text: Column) -> Column:
    """``"wind_speed >= 50"`` -> (metric, comparison, limit); nulls where it is not one."""
    pattern = rf"^\s*({'|'.join(METRICS)})\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)"
    part = [F.nullif(F.regexp_extract(text, pattern, n), F.lit("")) for n in (1, 2, 3)]
    return F.struct(
        part[0].alias("metric"),
        part[1].alias("comparison"),
        part[2].try_cast("double").alias("limit"),
    )


def met_conditions(conditions: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows with a ``location`` and a ``condition`` text that the latest reading meets."""
    read = conditions.withColumn("parts", condition_parts(F.col("condition"))).join(
        latest.select("location", "data_id", *METRICS), "location"
    )
    value = F.coalesce(
        *(F.when(F.col("parts.metric") == metric, F.col(metric)) for metric in METRICS)
    )
    limit = F.col("parts.limit")
    sign = F.col("parts.comparison")
    met = (
        F.when(sign == ">", F.col("value") > limit)
        .when(sign == ">=", F.col("value") >= limit)
        .when(sign == "<", F.col("value") < limit)
        .when(sign == "<=", F.col("value") <= limit)
    )
    return read.withColumn("value", value).where(met).select(*conditions.columns, "data_id", "value")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Active alerts by severity, and resolved ones, in one row. Critical counts as high."""
    level = F.initcap("severity")
    return alerts.agg(
        F.count_if(F.col("is_active") & level.isin("High", "Critical")).alias("high"),
        F.count_if(F.col("is_active") & (level == "Medium")).alias("medium"),
        F.count_if(F.col("is_active") & (level == "Low")).alias("low"),
        F.count_if(~F.col("is_active")).alias("resolved"),
    )


def audience_sizes(announcements: DataFrame, users: DataFrame) -> DataFrame:
    """How many users an announcement reaches: those of its location, or ``all`` of them.
    Users are counted per location first, so announcements never meet single users."""
    per_place = users.groupBy(F.col("location").alias("audience")).agg(F.count("*").alias("n"))
    everyone = users.agg(F.count("*")).scalar()
    reached = F.when(F.col("audience") == "all", everyone).otherwise(F.coalesce("n", F.lit(0)))
    return (
        announcements.join(per_place, "audience", "left")
        .withColumn("n_users", reached)
        .drop("n")
    )


def unexpired(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts with ``expiry_hours`` that still hold at ``as_of``."""
    return alerts.where(
        (F.col("created_at") <= as_of)
        & (plus_hours(F.col("created_at"), F.col("expiry_hours")) > as_of)
    )
