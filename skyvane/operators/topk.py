"""Global newest-first lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.operators.joins import activities_with_users


def newest(df: DataFrame, time: str, row_id: str, n: int | None = None) -> DataFrame:
    """Newest first, the id decides ties; with ``n`` only a per-task top ``n`` is merged."""
    ordered = df.orderBy(F.desc(time), F.desc(row_id))
    return ordered if n is None else ordered.limit(n)


def newest_with_users(
    activities: DataFrame, users: DataFrame, time: str, row_id: str, n: int
) -> DataFrame:
    """The ``n`` newest activities that have a user, with that user.

    Only user, time and id of an activity are looked at to choose; the chosen ``n`` rows are
    then joined with the rest of their columns and their user.
    """
    known = activities.select("user_id", time, row_id).join(
        users.select("user_id"), "user_id", "left_semi"
    )
    chosen = newest(known, time, row_id, n).select(row_id)
    few = activities_with_users(activities.join(chosen, row_id, "left_semi"), users)
    return newest(few, time, row_id, n)
