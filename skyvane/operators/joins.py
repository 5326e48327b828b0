"""Joins between users, activities, alerts and readings.

In every join one side is unique on the key (users, counts per user, latest reading per
location), so the output never grows beyond the other side. Adaptive execution can split a hot
key on the side that an outer join preserves, or on either side of an inner join; users with
optional children are therefore an inner join and the users without children. No side is broadcast by hint: the planner does it where
the measured size is below its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.operators import lookups


def activities_with_users(activities: DataFrame, users: DataFrame) -> DataFrame:
    return activities.join(users.select("user_id", "username", "location"), "user_id")


def users_with_activities(users: DataFrame, activities: DataFrame) -> DataFrame:
    return _with_optional(users, activities)


def users_with_active_alerts(users: DataFrame, alerts: DataFrame) -> DataFrame:
    """Users without an active alert are kept: the flag is tested before the outer join."""
    return _with_optional(users, lookups.active(alerts))


def _with_optional(users: DataFrame, children: DataFrame) -> DataFrame:
    """What a left join gives, with a hot user among the children spread over tasks. The ids
    of users with children are reduced before they are shuffled."""
    without = users.join(children.select("user_id").distinct(), "user_id", "left_anti")
    return users.join(children, "user_id").unionByName(without, allowMissingColumns=True)


def tracked_readings(readings: DataFrame, locations: DataFrame) -> DataFrame:
    return readings.join(locations.select("location"), "location", "left_semi")


def users_with_latest(users: DataFrame, latest: DataFrame) -> DataFrame:
    """``latest`` holds one reading per location; users elsewhere keep null readings."""
    return users.join(latest, "location", "left")


def orphans(children: DataFrame, users: DataFrame, child: str, child_id: str) -> DataFrame:
    """Rows of a child table whose user does not exist."""
    return children.join(users.select("user_id"), "user_id", "left_anti").select(
        F.lit(child).alias("child"), F.col(child_id).alias("child_id"), "user_id"
    )
