"""Checks that send bad rows to a quarantine with a reason instead of failing the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the forms accept.
SEVERITIES = ("Low", "Medium", "High", "Critical")
ALERT_TYPES = ("Temperature", "Wind", "Rain", "Precipitation", "Storm", "Uv")
ACTIVITIES = ("walking", "running", "cycling", "reading", "gardening", "swimming")
LOWEST_BOUND = -10
HIGHEST_BOUND = 40
RATINGS = (1, 5)


@dataclass(frozen=True)
class Checked:
    valid: DataFrame
    quarantine: DataFrame


def split(df: DataFrame, checks: dict[str, Column]) -> Checked:
    """``checks`` maps a reason to a condition that good rows meet; null counts as not met.
    A row is quarantined under its first failed reason."""
    marked = df.withColumn("reason", first_failure(checks))
    return Checked(
        valid=marked.where(F.col("reason").isNull()).drop("reason"),
        quarantine=marked.where(F.col("reason").isNotNull()),
    )


def first_failure(checks: dict[str, Column]) -> Column:
    return F.coalesce(
        *(
            F.when(~F.coalesce(condition, F.lit(False)), F.lit(reason))
            for reason, condition in checks.items()
        )
    )


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "")


def required_fields(*columns: str) -> dict[str, Column]:
    return {f"{column} is missing": filled(column) for column in columns}


def preference_range(low: Column, high: Column) -> dict[str, Column]:
    return {
        "minimum out of bounds": low.between(LOWEST_BOUND, HIGHEST_BOUND),
        "maximum out of bounds": high.between(LOWEST_BOUND, HIGHEST_BOUND),
        "minimum not below maximum": low < high,
    }


def alert_domains() -> dict[str, Column]:
    return {
        "unknown severity": F.initcap("severity").isin(*SEVERITIES),
        "unknown alert type": F.initcap("alert_type").isin(*ALERT_TYPES),
    }


def activity_domains() -> dict[str, Column]:
    return {
        "unknown activity": F.lower("activity_type").isin(*ACTIVITIES),
        "rating out of bounds": F.col("satisfaction_rating").between(*RATINGS),
    }
