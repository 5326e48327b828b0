"""Alert rules against readings.

A rule trips on a metric when the reading is at or above the stored threshold. Only active
alerts count, a threshold that is not stored never trips, and the thresholds apply whatever
the alert type says. The fixed warnings need no rule and use a strict comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions.nested import trigger_conditions
from skyvane.operators import lookups
from skyvane.session import checkpointed, settled

# Metrics a rule can name, defaults of a new rule, limits of the warnings.
METRICS = ("temperature", "wind_speed", "precipitation")
DEFAULT_THRESHOLDS = {"temperature": 30.0, "wind_speed": 50.0, "precipitation": 10.0}
RULE_COLUMNS = (
    "alert_id",
    "user_id",
    "username",
    "location",
    "alert_type",
    "severity",
    "message",
)
HEAT_LIMIT = 35
WIND_LIMIT = 50

# Rules in a file of those that ``trip_history`` writes.
RULES_PER_FILE = 300_000


def stored_rules(alerts: DataFrame) -> DataFrame:
    """Active alerts with their thresholds as ``<metric>_limit``; null where none is stored."""
    return _with_limits(lookups.active(alerts)).select(
        "alert_id",
        "user_id",
        "alert_type",
        "severity",
        "message",
        *(f"{metric}_limit" for metric in METRICS),
    )


def _with_limits(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "conditions", trigger_conditions(F.col("trigger_conditions"))
    ).withColumns({f"{metric}_limit": F.col(f"conditions.{metric}") for metric in METRICS})


def placed_rules(
    alerts: DataFrame, users: DataFrame, places: DataFrame | None = None
) -> DataFrame:
    """Stored rules with the name and location of their user; of users at ``places(location)``
    only, where given. Only the thresholds of rules that are kept are parsed."""
    people = users.select("user_id", "username", "location")
    if places is not None:
        people = people.join(places.select("location").distinct(), "location", "left_semi")
    return _with_limits(lookups.active(alerts).join(people, "user_id")).select(
        *RULE_COLUMNS, *(f"{metric}_limit" for metric in METRICS)
    )


def tripped_on_latest(alerts: DataFrame, users: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per alert and metric that the latest reading at the user's location trips.

    The readings are joined to the users first, so that the alerts, by far the largest
    input, are shuffled once, by user.
    """
    placed = users.select("user_id", "username", "location").join(
        latest.select("location", "data_id", "recorded_at", *METRICS), "location"
    )
    return _one_row_per_metric(stored_rules(alerts).join(placed, "user_id"))


def _is_over(metric: str) -> Column:
    return F.col(metric) >= F.col(f"{metric}_limit")


def _one_row_per_metric(matched: DataFrame) -> DataFrame:
    hits = F.array(
        *(
            F.when(
                _is_over(metric),
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.col(metric).alias("value"),
                    F.col(f"{metric}_limit").alias("threshold"),
                ),
            )
            for metric in METRICS
        )
    )
    return matched.select(
        *RULE_COLUMNS,
        "data_id",
        "recorded_at",
        F.inline(F.array_compact(hits)),
    )


def fixed_warnings(readings: DataFrame) -> DataFrame:
    """Heat above 35 and wind above 50; a reading over both gives two rows."""
    heat = F.when(
        F.col("temperature") > HEAT_LIMIT,
        F.struct(
            F.lit("Heat Warning").alias("title"),
            F.lit("Extreme temperature detected!").alias("message"),
            F.lit("warning").alias("level"),
        ),
    )
    wind = F.when(
        F.col("wind_speed") > WIND_LIMIT,
        F.struct(
            F.lit("Wind Warning").alias("title"),
            F.lit("High wind conditions!").alias("message"),
            F.lit("danger").alias("level"),
        ),
    )
    over = F.array_compact(F.array(heat, wind))
    return readings.where(
        (F.col("temperature") > HEAT_LIMIT) | (F.col("wind_speed") > WIND_LIMIT)
    ).select("data_id", "location", "temperature", "wind_speed", "recorded_at", F.inline(over))


def rule_floors(rules: DataFrame) -> DataFrame:
    """Per location the lowest stored threshold of each metric and the number of rules."""
    return rules.groupBy("location").agg(
        F.count("*").alias("n_rules"),
        *(F.min(f"{metric}_limit").alias(f"{metric}_floor") for metric in METRICS),
    )


def flagged(readings: DataFrame, floors: DataFrame) -> DataFrame:
    """Readings, batch or stream, with whether any rule of their location trips on them."""
    over = F.lit(False)
    for metric in METRICS:
        over = over | F.coalesce(F.col(metric) >= F.col(f"{metric}_floor"), F.lit(False))
    return readings.join(floors, "location", "left").select(
        "data_id",
        "location",
        "recorded_at",
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
        over.alias("trips_a_rule"),
    )


def by_metric(rules: DataFrame) -> DataFrame:
    """One row per rule and stored threshold."""
    return _by_metric(rules, *RULE_COLUMNS)


def _by_metric(rules: DataFrame, *columns: str) -> DataFrame:
    limits = F.array(
        *(
            F.struct(F.lit(metric).alias("metric"), F.col(f"{metric}_limit").alias("threshold"))
            for metric in METRICS
        )
    )
    return rules.select(*columns, F.inline(limits)).where(F.col("threshold").isNotNull())


def trip_history(rules: DataFrame, readings: DataFrame) -> DataFrame:
    """How often, when first, when last and how high each rule tripped over the readings, be
    they a whole history or a micro-batch.

    Never pairs rules with readings, and reads the readings once and the rules twice: for their
    distinct thresholds, and to give each rule what its thresholds come to. They are written once
    for both, as they are placed and parsed at some cost. Values and thresholds
    are laid out together by falling level, and a running total at a threshold is what lies at or
    above it. Even pieces of that order, cut by range, are totalled on their own, so many values
    or thresholds need not fit one task; one row per piece and place then carries the totals of
    the pieces before. The pieces depend on a sample, so they are cut once and checkpointed.
    Rules are mostly far more than thresholds; the totals are written before they are joined,
    so that rules are shuffled only to totals that are large themselves.
    """
    place = ("location", "metric")
    rules = settled(rules, "rules", RULES_PER_FILE)
    pieces = checkpointed(history_pieces(rules, readings))
    totals = (F.col("n"), F.col("first_at"), F.col("last_at"), F.col("value"))
    falling = Window.partitionBy(*place, "piece").orderBy(*_falling())
    so_far = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_piece = pieces.select(
        *place, "piece", "level", "asked", *_totals(*totals, lambda total: total.over(so_far))
    ).where("asked")

    earlier = Window.partitionBy(*place).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.groupBy(*place, "piece")
        .agg(*_totals(*totals, lambda total: total))
        .select(
            *place,
            "piece",
            *(
                total.alias(f"{name}_above")
                for name, total in zip(
                    TOTALS, _totals(*map(F.col, TOTALS), lambda total: total.over(earlier))
                )
            ),
        )
    )
    tripped = (
        in_piece.join(carried, [*place, "piece"])
        .select(
            *place,
            F.col("level").alias("threshold"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("n_above", F.lit(0))).alias("trips"),
            F.least("first_at", "first_at_above").alias("first_tripped_at"),
            F.greatest("last_at", "last_at_above").alias("last_tripped_at"),
            F.greatest("peak", "peak_above").alias("peak"),
        )
        .where(F.col("trips") > 0)
    )
    return (
        by_metric(rules)
        .join(settled(tripped, "trip-totals"), [*place, "threshold"])
        .select(
            *RULE_COLUMNS,
            "metric",
            "threshold",
            "trips",
            "first_tripped_at",
            "last_tripped_at",
            "peak",
        )
    )


TOTALS = ("n", "first_at", "last_at", "peak")


def _falling() -> list[Column]:
    """Thresholds come behind the values that equal them."""
    return [F.desc("level"), F.asc("asked")]


def history_pieces(rules: DataFrame, readings: DataFrame) -> DataFrame:
    """Distinct values with ``n, first_at, last_at, value``, and distinct thresholds, ``asked``,
    each at its ``level`` of a location and metric, and the number of the ``piece`` of that order."""
    limits = [f"{metric}_limit" for metric in METRICS]
    asked = (
        _by_metric(rules.select("location", *limits).distinct(), "location")
        .select("location", "metric", F.col("threshold").alias("level"))
        .distinct()
        .withColumn("asked", F.lit(True))
    )
    return (
        _value_counts(readings)
        .withColumns({"value": F.col("level"), "asked": F.lit(False)})
        .unionByName(asked, allowMissingColumns=True)
        .where("location IS NOT NULL")
        .repartitionByRange("location", "metric", *_falling())
        .withColumn("piece", F.spark_partition_id())
    )


def _value_counts(readings: DataFrame) -> DataFrame:
    """Distinct values per location and metric with how often, first and last they were read."""
    return (
        readings.select("location", "recorded_at", *METRICS)
        .unpivot(["location", "recorded_at"], list(METRICS), "metric", "level")
        .where("level IS NOT NULL")
        .groupBy("location", "metric", "level")
        .agg(
            F.count("*").alias("n"),
            F.min("recorded_at").alias("first_at"),
            F.max("recorded_at").alias("last_at"),
        )
    )


def _totals(
    n: Column, first_at: Column, last_at: Column, peak: Column, over: Callable[[Column], Column]
) -> list[Column]:
    totals = (F.sum(n), F.min(first_at), F.max(last_at), F.max(peak))
    return [over(total).alias(name) for name, total in zip(TOTALS, totals)]
