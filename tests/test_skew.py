"""Hot keys: one user or location with most of the rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from skyvane.operators import aggregates, joins, rules, windows

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def tiny_partitions(spark):
    """Sizes scaled down, so that a small hot key counts as a large one; nothing is broadcast."""
    before = {name: spark.conf.get(name, None) for name in SMALL_PARTITIONS}
    for name, value in SMALL_PARTITIONS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def executed(df):
    """The plan as it was run, and the rows."""
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


@pytest.fixture
def hot_activities(spark):
    """Nine in ten activities belong to user 7."""
    row = F.col("id")
    return spark.range(0, 200_000, 1, 16).select(
        row.alias("activity_id"),
        F.when(row % 10 != 0, 7).otherwise(row % 1000).cast("bigint").alias("user_id"),
        F.md5(row.cast("string")).alias("notes"),
    )


@pytest.fixture
def people(spark):
    return spark.range(1000).select(
        F.col("id").alias("user_id"),
        F.concat(F.lit("u"), "id").alias("username"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise("cold").alias("location"),
    )


def test_hot_user_is_split_in_the_join(tiny_partitions, hot_activities, people):
    joined = joins.activities_with_users(hot_activities, people)
    shown, rows = executed(joined)
    assert "skew=true" in shown
    assert len(rows) == 200_000


def test_hot_user_is_split_where_users_without_children_stay(
    tiny_partitions, spark, hot_activities, people
):
    more = people.unionByName(
        spark.range(5000, 5003).selectExpr("id AS user_id", "'n' AS username", "'cold' AS location")
    )
    shown, rows = executed(joins.users_with_activities(more, hot_activities))
    assert "skew=true" in shown
    assert sorted(r.user_id for r in rows if r.activity_id is None)[-3:] == [5000, 5001, 5002]
    assert sum(r.activity_id is not None for r in rows) == 200_000
    alerts = hot_activities.selectExpr("activity_id AS alert_id", "user_id", "notes", "true AS is_active")
    shown, rows = executed(joins.users_with_active_alerts(more, alerts))
    assert "skew=true" in shown
    assert sum(r.alert_id is not None for r in rows) == 200_000


def test_hot_user_is_counted_before_the_shuffle(tiny_partitions, hot_activities):
    counts = aggregates.activity_counts(hot_activities)
    shown, rows = executed(counts)
    assert "partial_count" in shown
    assert {r.user_id: r.activity_count for r in rows}[7] == 180_000


def test_hot_user_sends_few_rows_to_the_ranking(tiny_partitions, hot_activities):
    newest = windows.newest_per(hot_activities, "user_id", "activity_id", "activity_id", 10)
    rows = newest.where("user_id = 7").collect()
    assert sorted(r.activity_id for r in rows) == [199989, *range(199991, 200_000)]


def test_one_band_of_values_and_one_threshold_are_spread(spark):
    """A million values within one unit of one place, and ten thousand rules with one threshold."""
    n = 1_000_000
    row = F.col("id")
    readings = spark.range(0, n, 1, 8).select(
        F.lit("hot").alias("location"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=row)).alias("recorded_at"),
        (30 + row / n).alias("temperature"),
        F.lit(None).cast("double").alias("wind_speed"),
        F.lit(0.0).alias("precipitation"),
    )
    placed = spark.range(0, 20_000, 1, 2).select(
        row.alias("alert_id"),
        row.alias("user_id"),
        *(F.lit("x").alias(name) for name in ("username", "alert_type", "severity", "message")),
        F.lit("hot").alias("location"),
        F.when(row % 2 == 0, 30.5).otherwise(30 + row / 20_000).alias("temperature_limit"),
        F.lit(1.0).alias("wind_speed_limit"),
        F.lit(None).cast("double").alias("precipitation_limit"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = rules.history_pieces(placed, readings).groupBy("piece").count().collect()
        hits = rules.trip_history(placed, readings).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 2 * n / len(sizes)
    assert len(hits) == 20_000
    for r in hits:
        assert r.trips == n - round((r.threshold - 30) * n)
        assert r.peak == 30 + (n - 1) / n
        assert r.last_tripped_at - r.first_tripped_at == datetime.timedelta(seconds=r.trips - 1)


def test_rules_with_equal_thresholds_are_laid_out_once(spark):
    row = F.col("id")
    readings = spark.range(100).select(
        F.lit("hot").alias("location"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=row)).alias("recorded_at"),
        row.cast("double").alias("temperature"),
        F.lit(1.0).alias("wind_speed"),
        F.lit(None).cast("double").alias("precipitation"),
    )
    placed = spark.range(5000).select(
        (row % 4999).alias("alert_id"),  # one comes twice
        row.alias("user_id"),
        *(F.lit("x").alias(name) for name in ("username", "alert_type", "severity", "message")),
        F.lit("hot").alias("location"),
        F.when(row % 2 == 0, 30.0).otherwise(98.5).alias("temperature_limit"),
        F.lit(1.0).alias("wind_speed_limit"),
        F.lit(0.0).alias("precipitation_limit"),
    )
    # 101 values and 4 thresholds, however many rules there are
    assert rules.history_pieces(placed, readings).count() == 105
    hits = rules.trip_history(placed, readings)
    counts = hits.groupBy("metric", "threshold", "trips", "peak").count().collect()
    assert {tuple(r) for r in counts} == {
        ("temperature", 30.0, 70, 99.0, 2500),
        ("temperature", 98.5, 1, 99.0, 2500),
        ("wind_speed", 1.0, 100, 1.0, 5000),
    }
    assert hits.where("alert_id = 0").count() == 4


def test_rules_are_placed_once_for_thresholds_and_totals(spark):
    """What gives the rules, a join and parsed text, is not done again for each use of them."""
    taken = spark.sparkContext.accumulator(0)

    def limit(alert_id):
        taken.add(1)
        return 30.0 + alert_id % 3

    row = F.col("id")
    placed = spark.range(60).select(
        row.alias("alert_id"),
        row.alias("user_id"),
        *(F.lit("x").alias(name) for name in ("username", "alert_type", "severity", "message")),
        F.lit("hot").alias("location"),
        F.udf(limit, "double")("id").alias("temperature_limit"),
        F.lit(None).cast("double").alias("wind_speed_limit"),
        F.lit(None).cast("double").alias("precipitation_limit"),
    )
    readings = spark.range(2).select(
        F.lit("hot").alias("location"),
        F.lit("2024-01-01").cast("timestamp").alias("recorded_at"),
        (row + 30).cast("double").alias("temperature"),
        F.lit(1.0).alias("wind_speed"),
        F.lit(None).cast("double").alias("precipitation"),
    )
    hits = rules.trip_history(placed, readings).collect()
    assert sorted((r.threshold, r.trips) for r in hits) == [(30.0, 2)] * 20 + [(31.0, 1)] * 20
    assert taken.value == 60
