from __future__ import annotations

import datetime
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.checks import streams as checks
from skyvane.operators import joins, rules, windows
from skyvane.sources import payloads, sinks
from skyvane.sources.committed import (
    CommittedTable,
    Conflict,
    LatestReadings,
    Versions,
    feed_table,
    readings_table,
)
from skyvane.streaming import readings as live

START = datetime.datetime(2024, 1, 1, 10)


def land(folder, name, rows):
    """(id, location, temperature, minutes after ten) -> one landed file."""
    folder.mkdir(exist_ok=True)
    lines = []
    for i, place, temperature, minute in rows:
        body = {
            "main": {"temp": temperature, "humidity": 50, "pressure": 1000},
            "wind": {"speed": 60},
            "weather": [{"main": "Clear"}],
        }
        at = START + datetime.timedelta(minutes=minute)
        lines.append(
            json.dumps(
                {
                    "reading_id": i,
                    "location": place,
                    "status": 200,
                    "received_at": at.isoformat() + "Z",
                    "body": json.dumps(body),
                }
            )
        )
    (folder / name).write_text("\n".join(lines))


def stream(spark, folder):
    return payloads.readings(payloads.landed_stream(spark, str(folder), files_per_batch=1))


def run(query):
    query.awaitTermination()


def keyed(spark, folder, columns, late):
    return (
        CommittedTable(spark, str(folder / "out"), columns),
        CommittedTable(spark, str(folder / "late"), late),
        Versions(spark, str(folder / "held"), columns),
        str(folder / "keyed-state"),
    )


def test_late_reading_is_stored_but_not_in_a_closed_tick(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, "a", 1.0, 0), (2, "a", 2.0, 1), (3, "a", 3.0, 60)])
    stored = str(tmp_path / "stored")
    ticks, late, held, state = keyed(spark, tmp_path, live.TICKS, schemas.WEATHER_DATA)
    for _ in range(2):
        source = stream(spark, tmp_path / "in")
        run(live.store_readings(source, stored, str(tmp_path / "s1")))
        run(live.closed_ticks(source, ticks, late, held, state))
        land(tmp_path / "in", "b.json", [(4, "a", 9.0, 1), (5, "a", 5.0, 120)])
    assert sorted(r.data_id for r in sinks.stored_readings(spark, stored).collect()) == [1, 2, 3, 4, 5]
    first = [r for r in ticks.rows().collect() if r.tick_start == START]
    assert [(r.data_id, r.n) for r in first] == [(2, 2)]
    assert [r.data_id for r in late.rows().collect()] == [4]


def test_open_ticks_are_held_over_batches(spark, tmp_path):
    ticks, late, held, state = keyed(spark, tmp_path, live.TICKS, schemas.WEATHER_DATA)
    (tmp_path / "in").mkdir()
    source = stream(spark, tmp_path / "in")
    batches = [
        [(1, "a", 1.0, 4.0), (2, "b", 2.0, 4.5)],
        [(3, "a", 3.0, 5.5), (4, "a", 4.0, 4.1), (5, "b", 5.0, 4.5)],
        [(6, "a", 6.0, 16.0)],
        [(7, "a", 7.0, 5.9), (8, "a", 8.0, 16.5)],
    ]
    for k, rows in enumerate(batches):
        land(tmp_path / "in", f"{k}.json", rows)
        run(live.closed_ticks(source, ticks, late, held, state))
    got = {(r.location, r.data_id, r.n) for r in ticks.rows().collect()}
    assert got == {("a", 3, 3), ("b", 5, 2)}
    assert [r.data_id for r in late.rows().collect()] == [7]
    assert {(r.data_id, r.n) for r in held.rows().collect()} == {(8, 2)}
    # The last batch runs again.
    for name in ("3", ".3.crc"):
        (tmp_path / "keyed-state" / "commits" / name).unlink()
    run(live.closed_ticks(source, ticks, late, held, state))
    assert len(late.rows().collect()) == 1 and ticks.rows().count() == 2


def test_late_first_arrivals_are_kept_aside_and_once(spark, tmp_path):
    arrived, late, held, state = keyed(spark, tmp_path, live.ARRIVALS, live.ARRIVALS)
    batches = [
        [(1, "a", 1.0, 0), (2, "b", 1.0, 0), (3, "a", 1.0, 0)],
        [(4, "a", 1.0, 30), (5, "b", 1.0, 0)],
        [(6, "a", 1.0, 0), (7, "a", 1.0, 3), (8, "a", 1.0, 3), (9, "a", 1.0, 25), (10, "a", 1.0, 30)],
        [(11, "a", 1.0, 3), (12, "a", 1.0, 25), (13, "b", 1.0, 90)],
    ]
    for k, rows in enumerate(batches):
        land(tmp_path / "in", f"{k}.json", rows)
        run(live.first_arrivals(stream(spark, tmp_path / "in"), arrived, late, held, state))

    def minutes(rows):
        return sorted((r.location, (r.recorded_at - START).seconds // 60) for r in rows.collect())

    assert minutes(arrived.rows()) == [("a", 0), ("a", 25), ("a", 30), ("b", 0), ("b", 90)]
    assert minutes(late.rows()) == [("a", 3)]
    assert minutes(held.rows()) == [("b", 90)]


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, "a", 1.0, 0), (2, "b", 1.0, 0)])
    land(tmp_path / "in", "b.json", [(3, "a", 1.0, 0), (4, "a", 1.0, 2)])
    out = str(tmp_path / "out")
    kept = live.without_repeats(stream(spark, tmp_path / "in"))
    run(live.start_to_folder(kept, out, str(tmp_path / "state")))
    places = spark.read.parquet(out).groupBy("location").count().collect()
    assert {r.location: r["count"] for r in places} == {"a": 2, "b": 1}


def rule(spark, alert, limit):
    row = (alert, 1, "u", "a", "Temperature", "High", "m", limit, None, None)
    return spark.createDataFrame(
        [row],
        "alert_id BIGINT, user_id BIGINT, username STRING, location STRING, alert_type STRING, "
        "severity STRING, message STRING, temperature_limit DOUBLE, wind_speed_limit DOUBLE, "
        "precipitation_limit DOUBLE",
    )


def test_rules_are_read_again_for_every_batch(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, "a", 20.0, 0), (2, "a", 30.0, 1)])
    table = CommittedTable(spark, str(tmp_path / "out"), live.TRIPS)
    state = str(tmp_path / "state")
    current = [rule(spark, 1, 25.0)]
    source = stream(spark, tmp_path / "in")
    run(live.rule_alerts(source, lambda batch: current[0], table, state))
    current[0] = rule(spark, 2, 15.0)
    land(tmp_path / "in", "b.json", [(3, "a", 20.0, 2)])
    run(live.rule_alerts(source, lambda batch: current[0], table, state))
    got = {(r.alert_id, r.trips, r.peak) for r in table.rows().collect()}
    assert got == {(1, 1, 30.0), (2, 1, 20.0)}


class Live:
    """A live update over a landing folder, with one rule at place a."""

    def __init__(self, spark, folder):
        self.spark, self.landing, self.state = spark, folder / "in", str(folder / "state")
        self.table = readings_table(spark, str(folder / "table"))
        self.feed = feed_table(spark, str(folder / "feed"))
        self.latest = LatestReadings(spark, str(folder / "latest"))
        self.places = spark.createDataFrame([("a",), ("b",)], "location STRING")

    def update(self):
        run(
            live.live_update(
                stream(self.spark, self.landing),
                lambda: self.places,
                lambda batch: rule(self.spark, 7, 36.0),
                None,
                None,
                self.table,
                self.feed,
                self.state,
                every=None,
                latest=self.latest,
            )
        )

    def stored(self):
        return sorted(r.data_id for r in self.table.rows().collect())

    def events(self):
        return sorted(e.event for e in self.feed.rows().collect())


def test_live_update_stores_publishes_and_warns(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, "a", 36.0, 0), (2, "elsewhere", 36.0, 0)])
    own = Live(spark, tmp_path)
    own.update()
    own.update()
    assert own.stored() == [1]
    assert own.events() == ["alert_tripped", "warning", "warning", "weather_update"]
    (published,) = [
        json.loads(e.payload) for e in own.feed.rows().collect() if e.event == "weather_update"
    ]
    assert published["data"]["temperature"] == 36.0
    assert published["data"]["timestamp"] == "2024-01-01T10:00:00"
    assert "prediction" not in published


def test_alerts_of_a_feed_are_put_together_without_a_sort(spark):
    at = "2024-01-01T10:00:0"
    rows = [(7, "wind_speed", 2, 61.5, at + "5"), (7, "wind_speed", 3, 60.0, at + "9")]
    rows += [(7, "precipitation", 1, 12.0, None), (8, "wind_speed", 1, 55.0, at + "1")]
    names = ("alert_id", "metric", "trips", "peak", "timestamp")
    texts = [("alert_tripped", json.dumps(dict(zip(names, row)))) for row in rows]
    own = checks._put_together(spark.createDataFrame(texts, "event STRING, payload STRING"))
    assert sorted(map(tuple, own.drop("event").collect()), key=str) == [
        (7, "precipitation", 1, 12.0, None),
        (7, "wind_speed", 5, 61.5, at + "9"),
        (8, "wind_speed", 1, 55.0, at + "1"),
    ]
    planned = own._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in planned and "Sort" not in planned


def kept_is_latest(own):
    kept = sorted(own.latest.rows().collect(), key=str)
    found = windows.latest_per_location(own.table.rows().drop("recorded_date"))
    return kept == sorted(found.select(*own.latest.rows().columns).collect(), key=str)


def test_latest_is_kept_over_batches_and_late_readings(spark, tmp_path):
    own = Live(spark, tmp_path)
    batches = [
        [(1, "a", 1.0, 0), (2, "a", 2.0, 50), (3, "b", 3.0, 5)],
        [(4, "a", 4.0, 20), (5, "b", 5.0, 5)],  # late; and as new as the newest, decided by id
        [(6, "elsewhere", 6.0, 90)],
        [(7, "b", 7.0, 5), (8, "a", 8.0, 70), (9, "a", 9.0, 1)],
    ]
    for k, rows in enumerate(batches):
        land(tmp_path / "in", f"{k}.json", rows)
        own.update()
        assert kept_is_latest(own)
    assert {(r.location, r.data_id) for r in own.latest.rows().collect()} == {("a", 8), ("b", 7)}
    own.latest.vacuum(keep=1)
    assert kept_is_latest(own)


def test_a_batch_is_not_shuffled_to_few_locations(spark, tmp_path):
    """Its one task stores one file, where each location was a task of its own."""
    own = Live(spark, tmp_path)
    own.places = spark.createDataFrame([(f"p{i}",) for i in range(30)], "location STRING")
    land(tmp_path / "in", "a.json", [(i, f"p{i}", 20.0, i) for i in range(40)])
    own.update()
    assert own.stored() == list(range(30))
    assert len(list((tmp_path / "table" / "data").rglob("*.parquet"))) == 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The stream's record of its last batch is lost, as if the job had died just before it."""
    own = Live(spark, tmp_path)
    for k in range(3):
        land(tmp_path / "in", f"{k}.json", [(k, "a", 36.0, k), (10 + k, "b", 36.0, k)])
    own.update()
    before = own.stored(), own.events(), own.latest.commits.newest().number
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink()
    own.update()
    assert (own.stored(), own.events(), own.latest.commits.newest().number) == before
    assert own.stored() == [0, 1, 2, 10, 11, 12] and kept_is_latest(own)


def test_a_failure_in_the_middle_of_a_batch_is_made_good(spark, tmp_path, monkeypatch):
    """Readings are stored, the feed is not: the batch runs again and does what is missing."""
    land(tmp_path / "in", "a.json", [(1, "a", 36.0, 0)])
    own = Live(spark, tmp_path)
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "weather_updates", lambda scored: 1 / 0)
        with pytest.raises(StreamingQueryException):
            own.update()
    assert own.stored() == [1] and own.events() == []
    land(tmp_path / "in", "b.json", [(2, "b", 1.0, 0)])
    own.update()
    assert own.stored() == [1, 2] and kept_is_latest(own)
    assert own.events().count("weather_update") == 2 and own.events().count("alert_tripped") == 1


def readings_of(spark, rows):
    """(id, location, day of January) -> storable readings."""
    df = spark.createDataFrame(rows, "data_id BIGINT, location STRING, day INT")
    return sinks.storable(
        df.select(
            "data_id",
            "location",
            *(F.lit(1.0).alias(name) for name in ("temperature", "humidity", "pressure")),
            *(F.lit(0.0).alias(name) for name in ("wind_speed", "precipitation")),
            F.lit("Sunny").alias("weather_condition"),
            F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(8), "data_id", F.lit(0)).alias(
                "recorded_at"
            ),
        )
    )


def ids(table):
    return sorted(r.data_id for r in table.rows().collect())


def test_half_a_batch_is_never_read(spark, tmp_path):
    table = readings_table(spark, str(tmp_path / "table"))
    assert ids(table) == []
    assert table.append(readings_of(spark, [(1, "a", 1), (2, "a", 2)]), "one")
    assert not table.append(readings_of(spark, [(3, "a", 1)]), "one")
    table._written(readings_of(spark, [(4, "a", 1)]))  # a job that dies before its commit
    (tmp_path / "table" / "commits" / f"{2:020d}.json").write_text('{"number": 2, "key": "tw')
    assert ids(table) == [1, 2]
    assert table.append(readings_of(spark, [(5, "b", 1)]), "two")
    assert ids(table) == [1, 2, 5]
    assert table.commits.newest().number == 3
    assert not list((tmp_path / "table" / "staging").iterdir())


def test_readings_of_a_table_at_two_times_stay_apart_in_one_plan(spark, tmp_path):
    table = readings_table(spark, str(tmp_path / "table"))
    table.append(readings_of(spark, [(1, "a", 1)]), "one")
    before = table.rows()
    table.append(readings_of(spark, [(2, "a", 1)]), "two")
    both = before.agg(F.count("*").alias("n")).unionByName(table.rows().agg(F.count("*").alias("n")))
    assert sorted(r.n for r in both.collect()) == [1, 2]
    assert spark.range(1).select(
        before.agg(F.count("*")).scalar().alias("a"), table.rows().agg(F.count("*")).scalar().alias("b")
    ).first() == (1, 2)


def test_only_closed_days_are_compacted_and_late_rows_stay(spark, tmp_path):
    table = readings_table(spark, str(tmp_path / "table"))
    data = tmp_path / "table" / "data"
    for k in range(6):
        table.append(readings_of(spark, [(k, "a", 1), (10 + k, "b", 2), (20 + k, "a", 3)]), str(k))
    every = [*range(6), *range(10, 16), *range(20, 26)]

    def files(day):
        return len(list((data / f"recorded_date=2024-01-0{day}").glob("*.parquet")))

    assert [files(day) for day in (1, 2, 3)] == [6, 6, 6]
    days = table.compact(datetime.date(2024, 1, 3))
    assert [str(day) for day in days] == ["2024-01-01", "2024-01-02"] and ids(table) == every
    table._written(readings_of(spark, [(50, "a", 1)]))  # still being written
    table.append(readings_of(spark, [(30, "late", 1)]), "late")
    assert ids(table) == [*every, 30]
    assert table.vacuum(keep=2) == 12
    assert ids(table) == [*every, 30] and files(1) <= 4 and files(2) <= 2 and files(3) == 6
    assert table.vacuum(older_than_hours=-1) == 1 and ids(table) == [*every, 30]
    # Every file of the first day is rewritten again with what came late.
    for k in range(4):
        table.append(readings_of(spark, [(40 + k, "late", 1)]), f"late-{k}")
    assert table.compact(datetime.date(2024, 1, 2), most_files=1) == [datetime.date(2024, 1, 1)]
    table.vacuum()
    assert ids(table) == [*every, 30, 40, 41, 42, 43] and files(1) <= 2


def test_a_compaction_that_is_overtaken_gives_way(spark, tmp_path, monkeypatch):
    table = readings_table(spark, str(tmp_path / "table"))
    other = readings_table(spark, str(tmp_path / "table"))
    for k in range(3):
        table.append(readings_of(spark, [(k, "a", 1)]), str(k))
    written = table._written

    def overtaken(*given):
        write = written(*given)
        other.append(readings_of(spark, [(9, "a", 1)]), "meanwhile")
        other.compact(datetime.date(2024, 1, 2), most_files=1)
        return write

    monkeypatch.setattr(table, "_written", overtaken)
    with pytest.raises(Conflict):
        table.compact(datetime.date(2024, 1, 2), most_files=1)
    assert ids(table) == [0, 1, 2, 9]


def test_a_merge_that_is_overtaken_starts_again(spark, tmp_path, monkeypatch):
    own, other = (LatestReadings(spark, str(tmp_path / "latest")) for _ in range(2))
    columns = own.rows().columns
    first, second = (readings_of(spark, [(k, place, k)]).select(*columns) for k, place in ((1, "a"), (2, "b")))
    version = own._version
    calls = []

    def overtaken(entry):
        if not calls:
            calls.append(1)
            other.merge(second, "second")
        return version(entry)

    monkeypatch.setattr(own, "_version", overtaken)
    assert own.merge(first, "first")
    assert {(r.location, r.data_id) for r in own.rows().collect()} == {("a", 1), ("b", 2)}


def _batch(spark, tmp_path):
    land(tmp_path / "in", "a.json", [(1, "a", 20.0, 0)])
    return payloads.landed(spark, str(tmp_path / "in"))


def test_stream_and_batch_agree_on_tracked_warnings(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 30.0 + i, i) for i in range(12)]
    land(tmp_path / "in", "a.json", rows)
    places = spark.createDataFrame([("a",)], "location STRING")

    def warnings(source):
        return rules.fixed_warnings(joins.tracked_readings(source, places))

    out = str(tmp_path / "out")
    run(
        live.start_to_folder(
            warnings(stream(spark, tmp_path / "in")), out, str(tmp_path / "state")
        )
    )
    batch = warnings(payloads.readings(payloads.landed(spark, str(tmp_path / "in"))))
    key = ["data_id", "level"]
    streamed = {tuple(r) for r in spark.read.parquet(out).select(*key).collect()}
    assert streamed == {tuple(r) for r in batch.select(*key).collect()}
    assert len(streamed) == batch.count() == 9
