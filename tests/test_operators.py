from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.operators import (
    aggregates,
    joins,
    lookups,
    quality,
    rules,
    topk,
    trends,
    windows,
)
from skyvane.sources import inserts, payloads

START = datetime.datetime(2024, 1, 1)


def readings(spark, rows):
    """(id, location, temperature, minutes after the start) -> readings."""
    full = [
        (i, place, t, 50.0, 1000.0, 5.0, "Sunny", 0.0, START + datetime.timedelta(minutes=m))
        for i, place, t, m in rows
    ]
    return spark.createDataFrame(full, schemas.WEATHER_DATA)


def random_readings(spark, n, seed, hot_share=0.5, minutes=300):
    """Half of the rows at one location, many at the same instant."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        place = "hot" if rnd.random() < hot_share else f"place{rnd.randrange(4)}"
        minute = 60 if rnd.random() < 0.3 else rnd.randrange(minutes)
        rows.append((i, place, float(rnd.randrange(-50, 450)) / 10, minute))
    rnd.shuffle(rows)
    return rows, readings(spark, rows)


def next_by_hand(rows, steps):
    by_place = {}
    for i, place, t, m in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        by_place.setdefault(place, []).append((i, t))
    result = {}
    for series in by_place.values():
        for position, (i, _) in enumerate(series):
            later = position + steps
            result[i] = series[later] if later < len(series) else None
    return result


@pytest.mark.parametrize("steps", [1, 3, 24])
def test_next_rows_match_a_sorted_list(spark, steps):
    rows, df = random_readings(spark, 600, seed=steps, minutes=4000)
    followed = windows.with_next(df, "location", ["data_id", "temperature"], steps=steps)
    got = {
        row.data_id: None if row.next is None else (row.next.data_id, row.next.temperature)
        for row in followed.collect()
    }
    assert got == next_by_hand(rows, steps)


def test_next_rows_of_one_place_and_instant(spark):
    """Nine in ten rows share a place and a time, and come from the history gate."""
    rows = [(k, "hot", float(k % 40), 60) if k % 10 else (k, "cold", 1.0, k) for k in range(3000)]
    gated = lookups.with_enough_history(readings(spark, rows))
    followed = windows.with_next(gated, "location", ["data_id", "temperature"])
    got = {r.data_id: r.next and (r.next.data_id, r.next.temperature) for r in followed.collect()}
    assert got == next_by_hand(rows, 1)


def test_next_row_across_empty_hours(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", 2.0, 600), (3, "a", 3.0, 6000), (4, "b", 4.0, 5)]
    followed = windows.with_next(readings(spark, rows), "location", ["temperature"])
    got = {row.data_id: row.next and row.next.temperature for row in followed.collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None, 4: None}


def test_latest_is_decided_by_the_id_on_equal_times(spark):
    rows = [(1, "a", 1.0, 5), (2, "a", 2.0, 5), (3, "a", 3.0, 4), (9, "b", 9.0, 1)]
    latest = windows.latest_per_location(readings(spark, rows))
    assert {(r.location, r.data_id) for r in latest.collect()} == {("a", 2), ("b", 9)}


def test_latest_with_odd_times_and_ids(spark):
    """No time, no id, no place, times before 1970 and ids at both ends, narrow and whole rows."""
    top = (1 << 63) - 1
    rows = [
        (5, "untimed", 1.0, None),
        (6, "untimed", 2.0, None),
        (-top, "ends", 3.0, "1900-01-01 00:00:00.000001"),
        (top, "ends", 4.0, "1900-01-01 00:00:00"),
        (None, "unnamed", 5.0, "2024-01-01"),
        (-top - 1 + 1, "unnamed", 6.0, "2024-01-01"),
        (1, None, 7.0, "9999-12-31 23:59:59"),
        (top, "late", 8.0, "9999-12-31 23:59:59.999999"),
        (0, "late", 9.0, None),
        (top, "late", 8.0, "9999-12-31 23:59:59.999999"),
    ]
    df = spark.createDataFrame(
        [(*row[:3], "c", row[3]) for row in rows],
        "data_id BIGINT, location STRING, temperature DOUBLE, weather_condition STRING, at STRING",
    ).selectExpr("* EXCEPT (at)", "CAST(at AS TIMESTAMP) AS recorded_at")
    expected = {"untimed": 2.0, "ends": 3.0, "unnamed": 6.0, None: 7.0, "late": 8.0}
    for latest in (
        windows.latest_per_location(df, "temperature"),
        windows.latest_per_location(df),
    ):
        rows = latest.collect()
        assert {r.location: r.temperature for r in rows} == expected and len(rows) == 5


def test_newest_per_key_keeps_the_limit(spark):
    rows, df = random_readings(spark, 300, seed=5)
    got = windows.newest_per(df, "location", "recorded_at", "data_id", 5)
    assert {r["count"] for r in got.groupBy("location").count().collect()} == {5}


def placed(spark, rows):
    """(alert, location, temperature limit, wind limit, rain limit) -> placed rules."""
    full = [
        (i, i, f"user{i}", place, "Temperature", "High", "m", t, w, p)
        for i, place, t, w, p in rows
    ]
    return spark.createDataFrame(
        full,
        "alert_id BIGINT, user_id BIGINT, username STRING, location STRING, alert_type STRING, "
        "severity STRING, message STRING, temperature_limit DOUBLE, wind_speed_limit DOUBLE, "
        "precipitation_limit DOUBLE",
    )


def test_trip_history_matches_counting_by_hand(spark):
    rows, df = random_readings(spark, 500, seed=11)
    rnd = random.Random(3)
    limits = [
        (i, rnd.choice(["hot", "place1", "nowhere"]), rnd.choice([None, rnd.uniform(-6, 46), 20.5]), None, 0.0)
        for i in range(60)
    ]
    expected = {}
    for alert, place, limit, _, rain in limits:
        here = [(t, m) for _, p, t, m in rows if p == place]
        over = [(t, m) for t, m in here if limit is not None and t >= limit]
        if over:
            minutes = [m for _, m in over]
            expected[alert, "temperature"] = (
                len(over), min(minutes), max(minutes), max(t for t, _ in over)
            )
        if here:
            minutes = [m for _, m in here]
            expected[alert, "precipitation"] = (len(here), min(minutes), max(minutes), 0.0)
    got = {
        (r.alert_id, r.metric): (
            r.trips,
            (r.first_tripped_at - START).total_seconds() / 60,
            (r.last_tripped_at - START).total_seconds() / 60,
            r.peak,
        )
        for r in rules.trip_history(placed(spark, limits), df).collect()
    }
    assert got == expected


def alerts(spark, rows):
    full = [
        (i, user, "Temperature", "High", "m", conditions, active, START)
        for i, user, conditions, active in rows
    ]
    return spark.createDataFrame(full, schemas.WEATHER_ALERTS)


def users(spark, rows):
    full = [(i, f"u{i}", f"u{i}@example.com", place, None, START) for i, place in rows]
    return spark.createDataFrame(full, schemas.USERS)


def activities(spark, rows):
    full = [(i, user, "walking", "Sunny", 30, 4, START, None) for i, user in rows]
    return spark.createDataFrame(full, schemas.USER_ACTIVITIES)


def test_rules_trip_at_the_threshold_and_never_without_one(spark):
    latest = windows.latest_per_location(readings(spark, [(1, "a", 30.0, 0)]))
    people = users(spark, [(1, "a"), (2, "nowhere")])
    stored = alerts(
        spark,
        [
            (1, 1, '{"temperature": 30.0}', True),
            (2, 1, '{"temperature": 30.1}', True),
            (3, 1, '{"wind_speed": 5.0, "temperature": 1}', True),
            (4, 1, '{"temperature": 1}', False),
            (5, 1, "{broken", True),
            (6, 2, '{"temperature": 1}', True),
            (7, 99, '{"temperature": 1}', True),
        ],
    )
    hits = rules.tripped_on_latest(stored, people, latest).collect()
    assert sorted((h.alert_id, h.metric) for h in hits) == [
        (1, "temperature"),
        (3, "temperature"),
        (3, "wind_speed"),
    ]


def test_fixed_warnings_are_strict_and_may_both_fire(spark):
    base = readings(spark, [(1, "a", 35.0, 0), (2, "a", 35.1, 1), (3, "a", 36.0, 2)])
    windy = base.withColumn(
        "wind_speed", F.when(F.col("data_id") == 3, 51.0).otherwise(50.0)
    )
    got = sorted((r.data_id, r.level) for r in rules.fixed_warnings(windy).collect())
    assert got == [(2, "warning"), (3, "danger"), (3, "warning")]


def test_counts_do_not_multiply(spark):
    people = users(spark, [(1, "a"), (2, "a"), (3, "a")])
    done = activities(spark, [(1, 1), (2, 1), (3, 1)])
    stored = alerts(spark, [(1, 1, None, True), (2, 1, None, True), (3, 3, None, False)])
    got = {
        r.user_id: (r.activity_count, r.alert_count, r.active_alert_count)
        for r in aggregates.users_with_counts(people, done, stored).collect()
    }
    assert got == {1: (3, 2, 2), 2: (0, 0, 0), 3: (0, 1, 0)}


def test_orphans_are_reported_and_left_out_of_the_inner_join(spark):
    people = users(spark, [(1, "a")])
    done = activities(spark, [(1, 1), (2, 77)])
    reported = joins.orphans(done, people, "user_activities", "activity_id").collect()
    assert [(r.child_id, r.user_id) for r in reported] == [(2, 77)]
    assert joins.activities_with_users(done, people).count() == 1


@pytest.mark.parametrize("orphan", [None, 9])
def test_newest_activities_skip_those_without_a_user(spark, orphan):
    people = users(spark, [(1, "a"), (2, "a")])
    done = activities(spark, [(i, 99 if i == orphan else 1 + i % 2) for i in range(10)])
    got = topk.newest_with_users(done, people, "activity_date", "activity_id", 3)
    assert [r.activity_id for r in got.collect()] == ([9, 8, 7] if orphan is None else [8, 7, 6])


def test_minimum_history(spark):
    rows = [(i, "short", 1.0, i) for i in range(19)]
    rows += [(100 + i, "enough", 1.0, i) for i in range(20)]
    kept = lookups.with_enough_history(readings(spark, rows))
    assert {r.location for r in kept.collect()} == {"enough"}


def test_window_start_is_included(spark):
    rows = [(1, "a", 1.0, 0), (2, "a", 1.0, 1), (3, "a", 1.0, 60)]
    got = lookups.since(readings(spark, rows), "2024-01-01 01:01:00", 1)
    assert sorted(r.data_id for r in got.collect()) == [2, 3]


def test_preference_ranges(spark):
    rows = [(1, 15, 25), (2, 25, 25), (3, -11, 5), (4, 10, 41), (5, None, 3)]
    df = spark.createDataFrame(rows, "id INT, low INT, high INT")
    checked = quality.split(df, quality.preference_range(F.col("low"), F.col("high")))
    assert [r.id for r in checked.valid.collect()] == [1]
    assert {r.id: r.reason for r in checked.quarantine.collect()} == {
        2: "minimum not below maximum",
        3: "minimum out of bounds",
        4: "maximum out of bounds",
        5: "minimum out of bounds",
    }


def one_by_one(batch, taken):
    names = {name for name, _ in taken}
    mails = {mail for _, mail in taken}
    accepted = []
    for request, name, mail in sorted(batch):
        if name and name.strip() and mail and mail.strip():
            if name not in names and mail not in mails:
                names.add(name)
                mails.add(mail)
                accepted.append(request)
    return accepted


@pytest.mark.parametrize("seed", range(4))
def test_bulk_insert_equals_inserting_one_by_one(spark, seed):
    rnd = random.Random(seed)
    batch = [
        (
            request,
            rnd.choice([None, " ", *(f"name{k}" for k in range(14))]),
            rnd.choice([None, *(f"mail{k}" for k in range(14))]),
        )
        for request in range(60)
    ]
    taken = [("name0", "mail5"), ("name3", "other")]
    checked = inserts.insert_unique(
        spark.createDataFrame(batch, "request_id BIGINT, username STRING, email STRING"),
        spark.createDataFrame(taken, "username STRING, email STRING"),
    )
    accepted = sorted(r.request_id for r in checked.valid.collect())
    refused = sorted(r.request_id for r in checked.quarantine.collect())
    assert accepted == one_by_one(batch, taken)
    assert sorted(accepted + refused) == list(range(60))


def reasons_one_by_one(batch):
    names, mails, reasons = set(), set(), {}
    for request, name, mail in sorted(batch):
        if name in names:
            reasons[request] = "username repeated"
        elif mail in mails:
            reasons[request] = "email repeated"
        else:
            names.add(name)
            mails.add(mail)
    return reasons


def chain(ids, start=0):
    """Rows of which each shares its name with one neighbour and its mailbox with the other."""
    return [
        (request, f"n{start}-{(k + 1) // 2}", f"m{start}-{k // 2}") for k, request in enumerate(ids)
    ]


REQUEST = "request_id BIGINT, username STRING, email STRING"


def counted_rounds(monkeypatch):
    cuts = []
    cut = inserts.checkpointed
    monkeypatch.setattr(inserts, "checkpointed", lambda df: cuts.append(1) or cut(df))
    return cuts


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    batch = chain(range(10_000))
    cuts = counted_rounds(monkeypatch)
    checked = inserts.insert_unique(
        spark.createDataFrame(batch, REQUEST).repartition(8, "email"),
        spark.createDataFrame([], "username STRING, email STRING"),
        rounds=3,
    )
    assert len(cuts) < 45  # the lineage is cut twice in each of about 14 steps of doubling
    assert sorted(r.request_id for r in checked.valid.collect()) == list(range(0, 10_000, 2))
    assert {r.request_id: r.reason for r in checked.quarantine.collect()} == reasons_one_by_one(batch)


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_any_order_equal_inserting_one_by_one(spark, seed):
    """Chains, rings, pairs that share both keys, and chains that hang on keys of many rows."""
    rnd = random.Random(seed)
    ids = iter(rnd.sample(range(1000), 300))
    batch = []
    for k, n in enumerate((1, 2, 3, 8, 30, 41)):
        batch += chain([next(ids) for _ in range(n)], k)
    ring = chain([next(ids) for _ in range(12)], "ring")
    batch += [(request, name.replace("ring-6", "ring-0"), mail) for request, name, mail in ring]
    batch += [(next(ids), "same", "same") for _ in range(2)]
    for k in range(6):
        hanging = chain([next(ids) for _ in range(9)], f"hang{k}")
        batch += [(hanging[0][0], "many", hanging[0][2]), *hanging[1:]]
    batch += [(next(ids), f"name{rnd.randrange(9)}", f"mail{rnd.randrange(9)}") for _ in range(30)]
    checked = inserts.insert_unique(
        spark.createDataFrame(batch, REQUEST),
        spark.createDataFrame([], "username STRING, email STRING"),
    )
    reasons = reasons_one_by_one(batch)
    assert {r.request_id: r.reason for r in checked.quarantine.collect()} == reasons
    assert {r.request_id for r in checked.valid.collect()} == {r[0] for r in batch} - set(reasons)


def test_rows_that_never_settle_within_the_rounds_raise(spark):
    # A chain whose every name and mailbox is asked for a third time, by later rows.
    batch = chain(range(20))
    batch += [(100 + k, row[1], f"own{k}") for k, row in enumerate(batch[::2])]
    batch += [(200 + k, f"own{k}", row[2]) for k, row in enumerate(batch[1:20:2])]
    empty = spark.createDataFrame([], "username STRING, email STRING")
    with pytest.raises(RuntimeError, match="2 rounds"):
        inserts.insert_unique(spark.createDataFrame(batch, REQUEST), empty, rounds=2)
    checked = inserts.insert_unique(spark.createDataFrame(batch, REQUEST), empty)
    assert {r.request_id for r in checked.quarantine.collect()} == set(reasons_one_by_one(batch))


def test_refused_rows_say_why(spark):
    batch = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "taken", "z"), (5, "", "w")]
    checked = inserts.insert_unique(
        spark.createDataFrame(batch, "request_id BIGINT, username STRING, email STRING"),
        spark.createDataFrame([("taken", "t")], "username STRING, email STRING"),
    )
    assert {r.request_id: r.reason for r in checked.quarantine.collect()} == {
        2: "username repeated",
        3: "email repeated",
        4: "username exists",
        5: "username is missing",
    }


def test_insert_into_a_full_table_accepts_nothing(spark):
    schema = "request_id BIGINT, username STRING, email STRING"
    batch = spark.createDataFrame([(1, "a", "x")], schema)
    checked = inserts.insert_unique(batch, batch.select("username", "email"))
    assert checked.valid.count() == 0
    assert checked.quarantine.count() == 1


def test_new_ids_are_unique_and_above_the_used_ones(spark):
    rows = spark.range(1000).selectExpr("id AS old").repartition(7)
    existing = spark.createDataFrame([(41,), (5,)], "key BIGINT")
    ids = [r.key for r in inserts.with_new_ids(rows, existing, "key").collect()]
    assert len(set(ids)) == 1000 and min(ids) == 42
    assert inserts.with_new_ids(rows, existing.limit(0), "key").agg(F.min("key")).first()[0] == 1


GOOD = (
    '{"main": {"temp": 7.5, "humidity": 60, "pressure": 1001}, "wind": {"speed": 3}, '
    '"weather": [{"main": "Rain"}], "rain": {"1h": 0.4}}'
)


@pytest.mark.parametrize(
    ("status", "body", "is_fallback"),
    [
        (200, GOOD, False),
        (500, GOOD, True),
        (None, GOOD, True),
        (200, GOOD.replace('"wind": {"speed": 3}, ', ""), True),
        (200, GOOD.replace('[{"main": "Rain"}]', "[]"), True),
        (200, GOOD.replace('"temp": 7.5', '"temp": null'), True),
        (200, "<html>", True),
        (200, None, True),
    ],
)
def test_whole_record_fallback(spark, status, body, is_fallback):
    landed = spark.createDataFrame([(1, "a", status, START, body)], schemas.LANDED_PAYLOAD)
    row = payloads.readings(landed).first()
    assert row.is_fallback is is_fallback
    expected = (20.0, 65.0, 1013.0, 10.0, "Sunny", 0.0) if is_fallback else (7.5, 60.0, 1001.0, 3.0, "Rain", 0.4)
    got = (row.temperature, row.humidity, row.pressure, row.wind_speed, row.weather_condition, row.precipitation)
    assert got == expected


def test_rain_is_zero_where_the_answer_names_none(spark):
    body = GOOD.replace(', "rain": {"1h": 0.4}', "")
    landed = spark.createDataFrame([(1, "a", 200, START, body)], schemas.LANDED_PAYLOAD)
    row = payloads.readings(landed).first()
    assert (row.precipitation, row.is_fallback) == (0.0, False)


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("temperature > 35°C", ("temperature", ">", 35.0)),
        ("  wind_speed>=50.5 km/h", ("wind_speed", ">=", 50.5)),
        ("precipitation < -1", ("precipitation", "<", -1.0)),
        ("when cold", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_condition_parts(spark, condition, expected):
    df = spark.createDataFrame([(condition,)], "c STRING")
    assert tuple(df.select(trends.condition_parts(F.col("c"))).first()[0]) == expected
