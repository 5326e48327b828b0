"""Physical plans: what reaches the scan, what is shuffled, what never appears."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from conftest import SMALL
from skyvane.checks.registry import QUERIES
from skyvane.operators import lookups, rules, windows
from skyvane.sources import inserts

# These run a stream, write a table or fit a model when they are called.
ACTING = ("j7_rules_on_all", "t1", "t2", "t3_fixed_warnings_stream", "t4", "t6_ticks_stream", "t7", "t8", "j10", "q10",
          "w2_kept", "q6_kept", "q7_kept", "t5_kept",
          "q11", "s4", "s6", "s12", "s13", "m4", "m5", "m6", "m7", "m8", "d10", "d11_train", "d14",
          "d15", "d16_precipitation_model", "d17", "t5_current_with")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(ACTING)])
def test_no_pairing_and_no_python(spark, name):
    shown = plan(QUERIES[name](spark, SMALL))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in shown


def test_window_and_place_reach_the_scan(spark):
    shown = plan(QUERIES["f4_readings_since"](spark, SMALL))
    assert "GreaterThanOrEqual(ts," in shown


def test_stored_table_prunes_days_and_places(spark, tmp_path, tables):
    from skyvane.sources import sinks

    table = str(tmp_path / "weather")
    sinks.append_readings(tables.weather, table)
    stored = sinks.stored_readings(spark, table)
    recent = lookups.since(lookups.at_location(stored, "NATION_7"), "2024-01-31 00:00:00", 48)
    shown = plan(recent)
    assert "EqualTo(location,NATION_7)" in shown
    assert "PartitionFilters: [isnotnull(recorded_date" in shown
    bound = plan(lookups.history(stored, "NATION_7", 48, "2024-01-31 00:00:00"))
    assert "PartitionFilters: [isnotnull(recorded_date" in bound
    batch = tables.weather.where("recorded_at >= '2024-01-29 00:00:00'")
    batch = batch.select(*sinks.STORED_READING).withColumn(
        "recorded_at", F.col("recorded_at").cast("timestamp")
    )
    fresh = inserts.insert_new_readings(batch, stored)
    assert "PartitionFilters: [isnotnull(recorded_date" in plan(fresh) and fresh.count() == 0


def test_compaction_leaves_few_files_and_every_reading(spark, tmp_path, tables):
    from pathlib import Path

    from skyvane.sources import sinks

    scattered, compacted, cut = (str(tmp_path / name) for name in ("scattered", "compacted", "cut"))
    sinks.append_readings(tables.weather.repartition(12, "data_id"), scattered)
    stored = sinks.stored_readings(spark, scattered)
    sinks.compact_readings(stored, compacted)
    sinks.compact_readings(stored, cut, rows_per_file=10)

    def files(table: str) -> int:
        return len(list(Path(table).rglob("*.parquet")))

    days = stored.select("recorded_date").distinct().count()
    assert files(scattered) > 3 * days and files(compacted) <= days + 8 < files(cut)
    for table in (compacted, cut):
        again = sinks.stored_readings(spark, table)
        assert again.count() == stored.count() and again.exceptAll(stored).isEmpty()


def test_latest_reading_scans_only_what_it_needs(spark):
    shown = plan(QUERIES["q7_tripped_alerts"](spark, SMALL))
    (events,) = [line for line in shown.splitlines() if "ReadSchema" in line and "event_id" in line]
    assert "event_type" not in events and "props" not in events


def test_group_limit_runs_before_the_shuffle(spark, tables):
    newest = windows.newest_per(tables.activities, "user_id", "activity_date", "activity_id", 10)
    assert plan(newest).count("WindowGroupLimit") >= 2


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["q2_recent_activities"](spark, SMALL))


def exchanges(df) -> list[str]:
    shown = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in shown.splitlines() if "Exchange" in line]


def test_next_row_is_cut_by_range_after_the_history_gate(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gated = lookups.with_enough_history(tables.weather)
        found = exchanges(windows.with_next(gated, "location", ["temperature"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("rangepartitioning" in line for line in found)
    assert any("_piece" in line for line in found)


def test_preferences_are_parsed_once(spark):
    df = QUERIES["q6_recommendations"](spark, SMALL)
    assert df._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_trip_history_reads_rules_and_readings_once(spark, tables):
    placed = rules.placed_rules(tables.alerts, tables.users)
    points = rules.history_pieces(placed, tables.weather)
    simple = points._jdf.queryExecution().executedPlan().toString()
    assert simple.count("from_json") == 1 and simple.count("Expand") == 1
    assert simple.count("orders.parquet") == simple.count("events.parquet") == 1
    shown = plan(rules.trip_history(placed, tables.weather))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct"):
        assert node not in shown


def test_rules_elsewhere_are_not_parsed(spark, tables):
    at_place = tables.weather.where("location = 'NATION_7'")
    here = rules.placed_rules(tables.alerts, tables.users, at_place)
    shown = here._jdf.queryExecution().executedPlan().toString()
    lines = shown.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    parsed = next(i for i, line in enumerate(lines) if "from_json" in line)
    assert shown.count("from_json") == 1 and parsed < semi
    placed = rules.placed_rules(tables.alerts, tables.users)
    assert here.exceptAll(placed.where("location = 'NATION_7'")).isEmpty()
    assert here.count() == placed.where("location = 'NATION_7'").count()


@pytest.mark.parametrize(
    "name",
    ["w2_latest_per_location", "j5_users_latest_reading", "j7_rules_on_latest_reading",
     "j8_preferences_latest_reading", "q6_recommendations", "q7_tripped_alerts",
     "d6_free_text_conditions", "d13_avoidances", "t5_current_reading"],
)
def test_latest_reading_sorts_nothing_to_aggregate(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SMALL))


def test_fixed_width_columns_of_the_latest_reading_take_one_pass(spark, tables):
    narrow = windows.latest_per_location(tables.weather, "temperature", "wind_speed")
    shown = plan(narrow)
    assert shown.count("events.parquet") == 1 and "Join" not in shown
    assert plan(windows.latest_per_location(tables.weather)).count("events.parquet") == 2


def test_winning_rows_are_fetched_from_their_days(spark, tmp_path, tables):
    from skyvane.sources import sinks

    table = str(tmp_path / "weather")
    sinks.append_readings(tables.weather, table)
    stored = sinks.stored_readings(spark, table)
    latest = windows.latest_per_location(stored)
    rows = latest.collect()
    shown = latest._jdf.queryExecution().executedPlan().toString()
    assert "recorded_date" in shown and "Subquery" in shown and "SortAggregate" not in shown
    (pruned,) = [
        line for line in shown.splitlines() if "FileScan" in line and "Subquery" in line
    ][:1]
    assert "PartitionFilters: [((recorded_date" in pruned
    expected = windows.latest_per_location(tables.weather, "temperature").collect()
    assert {(r.location, r.data_id) for r in rows} == {(r.location, r.data_id) for r in expected}
