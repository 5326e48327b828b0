"""Bulk inserts: unique users, repeat-free readings, new alerts, defaults and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions.nested import json_object
from skyvane.functions.numbers import double_or, int_or
from skyvane.operators.quality import Checked, first_failure, required_fields
from skyvane.operators.rules import DEFAULT_THRESHOLDS
from skyvane.session import checkpointed

# Bounds of a preference form that leaves them out.
DEFAULT_MINIMUM = 15
DEFAULT_MAXIMUM = 25


# Rounds after which a bulk insert gives up. Each one settles what depends on rows settled
# before it; chains of rows that share keys in pairs take one round, however long they are.
ROUNDS = 100


def insert_unique(
    batch: DataFrame,
    existing: DataFrame,
    keys: tuple[str, ...] = ("username", "email"),
    order: str = "request_id",
    rounds: int = ROUNDS,
) -> Checked:
    """What inserting the rows of ``batch`` one by one, by ``order``, would accept.

    A row is refused when one of its keys is taken, by an existing row or by a row accepted
    before it. Each round accepts the rows that come first under all their keys and refuses
    the rows that share a key with them; what is left goes to the next round. From the second
    round on, chains of rows that hang on such a first one by keys shared in pairs are settled
    whole. Firsts are minima, so a key repeated very often is reduced before the shuffle. Mostly
    one or two rounds are needed; the lineage is cut after each. Raises RuntimeError if
    ``rounds`` do not suffice. ``order`` is unique.
    """
    named = batch.withColumn("reason", first_failure(required_fields(*keys)))
    judged = checkpointed(_with_taken_keys(named, existing, keys, "{} exists"))
    refused = judged.where(F.col("reason").isNotNull())
    accepted, repeated = [], []
    undecided = judged.where(F.col("reason").isNull())
    while not undecided.isEmpty():
        if len(accepted) == rounds:
            raise RuntimeError(f"rows still depend on each other after {rounds} rounds")
        firsts = [
            undecided.groupBy(key).agg(F.min(order).alias(order)).select(order) for key in keys
        ]
        taken = reduce(lambda left, right: left.join(right, order, "left_semi"), firsts)
        if accepted:
            taken = taken.unionByName(_accepted_in_chains(undecided, keys, order))
        winners = checkpointed(undecided.join(taken, order, "left_semi"))
        rest = undecided.join(winners.select(order), order, "left_anti")
        judged = checkpointed(_with_taken_keys(rest, winners, keys, "{} repeated", order))
        accepted.append(winners)
        repeated.append(judged.where(F.col("reason").isNotNull()))
        undecided = judged.where(F.col("reason").isNull())
    valid = reduce(DataFrame.unionByName, accepted, named.limit(0))
    if repeated:
        # A key may be taken by a row that was accepted in a later round.
        again = reduce(DataFrame.unionByName, repeated).withColumn("reason", F.lit(None).cast("string"))
        refused = refused.unionByName(_with_taken_keys(again, valid, keys, "{} repeated", order))
    return Checked(valid=valid.drop("reason"), quarantine=refused)


def _with_taken_keys(
    rows: DataFrame,
    owners: DataFrame,
    keys: tuple[str, ...],
    reason: str,
    order: str | None = None,
) -> DataFrame:
    """Set the reason of rows that have none yet and share a key with an owner. Owners' keys are
    unique, so rows are neither multiplied nor is a hot key on both sides: where ``order`` is
    given they are accepted rows, and only rows that come behind them count, else they are made
    so."""
    columns = rows.columns
    reasons = [F.col("reason")]
    for key in keys:
        taken = f"_{key}_taken"
        if order:
            owned = owners.select(key, F.col(order).alias(taken))
            is_taken = F.col(taken) < F.col(order)
        else:
            owned = owners.select(key, F.lit(True).alias(taken)).distinct()
            is_taken = F.col(taken)
        rows = rows.join(owned, key, "left")
        reasons.append(F.when(is_taken, F.lit(reason.format(key))))
    return rows.withColumn("reason", F.coalesce(*reasons)).select(*columns)


def _accepted_in_chains(undecided: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """``order`` of the accepted rows in chains: rows that share none of their keys with more
    than one other row, and only one of whose partners comes before them. Such a row is accepted
    if that partner is refused, so it alternates along the chain from a row without any before
    it. Each step doubles how far a row looks back, and a row is looked at by two at most, so
    neither the length of a chain nor its first row puts many rows into one task.
    """
    small = [
        undecided.groupBy(key)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
        .where("n <= 2")
        .select(
            F.explode(F.array_distinct(F.array("first", "last"))).alias("id"), "first", "n"
        )
        for key in keys
    ]
    before = F.when((F.col("n") == 2) & (F.col("id") != F.col("first")), F.col("first"))
    paired = checkpointed(
        reduce(DataFrame.unionByName, small)
        .groupBy("id")
        .agg(
            F.count("*").alias("n"),
            F.min(before).alias("to"),
            F.max(before).alias("other"),
        )
        .where((F.col("n") == len(keys)) & F.col("to").eqNullSafe(F.col("other")))
        .select("id", "to")
    )
    starts = paired.where("to IS NULL").select(F.col("id").alias("to"), F.lit(True).alias("starts"))
    # Whether the row looked at starts a chain, and whether it is an odd number of steps away.
    links = checkpointed(
        paired.where("to IS NOT NULL")
        .join(starts, "to", "left")
        .select("id", "to", F.coalesce("starts", F.lit(False)).alias("starts"), F.lit(True).alias("odd"))
    )
    while True:
        ahead = links.select(
            F.col("id").alias("to"),
            F.col("to").alias("next"),
            F.col("starts").alias("next_starts"),
            F.col("odd").alias("next_odd"),
        )
        moved = checkpointed(
            links.where("NOT starts")
            .join(ahead, "to")
            .select(
                "id",
                F.col("next").alias("to"),
                F.col("next_starts").alias("starts"),
                (F.col("odd") != F.col("next_odd")).alias("odd"),
            )
        )
        if moved.isEmpty():
            return links.where("starts AND NOT odd").select(F.col("id").alias(order))
        still = links.join(moved.select("id"), "id", "left_anti")
        links = checkpointed(still.unionByName(moved))


def insert_new_readings(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Readings without repeats of (location, time); the lowest id of a repeat is kept. A
    reading without a time repeats no other one. Of an ``existing`` table partitioned by
    ``recorded_date`` only the days between the batch's first and last are read."""
    others = [name for name in batch.columns if name not in ("location", "recorded_at")]
    untimed = batch.where("recorded_at IS NULL")
    fresh = (
        batch.where("recorded_at IS NOT NULL")
        .groupBy("location", "recorded_at")
        .agg(F.min_by(F.struct(*others), F.col("data_id")).alias("kept"))
        .select("location", "recorded_at", "kept.*")
        .select(*batch.columns)
    )
    if existing is not None:
        if "recorded_date" in existing.columns:
            day = F.to_date("recorded_at")
            first, last = (batch.agg(end(day)).scalar() for end in (F.min, F.max))
            existing = existing.where(F.col("recorded_date").between(first, last))
        stored = existing.select("location", "recorded_at")
        fresh = fresh.join(stored, ["location", "recorded_at"], "left_anti").select(*batch.columns)
    return fresh.unionByName(untimed)


def preference_forms(forms: DataFrame) -> DataFrame:
    """Submitted text fields -> stored preference text."""
    return forms.withColumn(
        "preferences",
        json_object(
            F.col("preferred_activities"),
            int_or(F.col("temperature_min"), DEFAULT_MINIMUM).alias("temperature_min"),
            int_or(F.col("temperature_max"), DEFAULT_MAXIMUM).alias("temperature_max"),
            F.col("avoid_rain").isNotNull().alias("avoid_rain"),
            F.col("avoid_extreme_heat").isNotNull().alias("avoid_extreme_heat"),
        ),
    )


def new_alerts(requests: DataFrame, now: str) -> DataFrame:
    """Submitted alerts -> rows to store: thresholds as JSON, defaults filled."""
    return requests.select(
        "user_id",
        "alert_type",
        "severity",
        "message",
        json_object(
            double_or(F.col("temp_threshold"), DEFAULT_THRESHOLDS["temperature"]).alias(
                "temperature"
            ),
            F.lit(DEFAULT_THRESHOLDS["wind_speed"]).alias("wind_speed"),
            F.lit(DEFAULT_THRESHOLDS["precipitation"]).alias("precipitation"),
        ).alias("trigger_conditions"),
        F.lit(True).alias("is_active"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    )


def with_defaults(rows: DataFrame, now: str | None = None) -> DataFrame:
    """Fill the columns that have a default: times with ``now``, ``is_active`` with true."""
    fills = {}
    for column in ("created_at", "recorded_at", "activity_date"):
        if column in rows.columns:
            moment = F.current_timestamp() if now is None else F.lit(now)
            fills[column] = F.coalesce(column, moment.cast(rows.schema[column].dataType))
    if "is_active" in rows.columns:
        fills["is_active"] = F.coalesce("is_active", F.lit(True))
    return rows.withColumns(fills)


def with_new_ids(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Unique, not dense, ids above those in use; checkpointed so that a lost task cannot
    hand out other ids on its second run."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    numbered = rows.withColumn(key, F.monotonically_increasing_id())
    return checkpointed(numbered.withColumn(key, F.col(key) + highest + 1))
