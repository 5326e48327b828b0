"""Streams over the driver tables, run until they have taken everything, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.checks import composites  # noqa: F401  registers what is compared to below
from skyvane.checks.base_views import LATEST, LIMITS, PARSED, TRIPS, landed_payloads
from skyvane.checks.models import KNOWN, trained
from skyvane.checks.registry import PLACE, register, register_all, register_same
from skyvane.checks.relational import READING_COLUMNS
from skyvane.functions.times import iso_text
from skyvane.operators import aggregates, rules
from skyvane.plans import alerts, dashboard, profiles
from skyvane.session import shared_folder
from skyvane.sources import payloads, sinks
from skyvane.sources.committed import (
    CommittedTable,
    LatestReadings,
    Versions,
    feed_table,
    readings_table,
)
from skyvane.sources.tables import (
    CUSTOMER,
    EVENTS,
    NATION,
    ORDERS,
    alerts_from,
    driver_table,
    driver_tables,
    users_from,
    weather_from,
)
from skyvane.streaming import readings as live

FEED = "event STRING, payload STRING"
TRIPPED = "alert_id BIGINT, metric STRING, trips BIGINT, peak DOUBLE, timestamp TIMESTAMP_NTZ"


def _stream(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    return (
        spark.readStream.schema(columns)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(folder)
    )


def _weather_stream(spark: SparkSession, folder: str) -> DataFrame:
    return weather_from(_stream(spark, folder, "events", EVENTS))


def _run(stream: DataFrame, purpose: str, file_format: str = "parquet") -> str:
    """Run a stream into a fresh folder and give the folder back."""
    spark = stream.sparkSession
    target = shared_folder(spark, purpose)
    live.start_to_folder(
        stream, target, shared_folder(spark, f"{purpose}-state"), file_format
    ).awaitTermination()
    return target


def _without_zone(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            field.name: F.col(field.name).cast("timestamp_ntz")
            for field in df.schema
            if field.dataType.typeName() == "timestamp"
        }
    )


def _stored(spark, folder: str) -> DataFrame:
    """Readings of tracked locations, stored by the stream."""
    tracked = aggregates.locations_of(driver_tables(spark, folder).users)
    stream = _weather_stream(spark, folder).join(tracked, "location", "left_semi")
    target = shared_folder(spark, "live-readings")
    state = shared_folder(spark, "live-readings-state")
    live.store_readings(stream, target, state).awaitTermination()
    stored = _without_zone(sinks.stored_readings(spark, target))
    return stored.withColumn("recorded_date", F.col("recorded_date").cast("string"))


def _without_numbers(feed: DataFrame) -> DataFrame:
    """Feed rows with a mark in place of a prediction and its confidence, numbers of the model."""
    numbers = r'"predicted_temperature":-?[0-9]+\.[0-9],"confidence":0\.[6-9][0-9]*'
    return feed.withColumn("payload", F.regexp_replace("payload", numbers, '"is_predicted":true'))


def _scored(spark, folder: str) -> DataFrame:
    """Feed rows of all readings with the prediction of the model."""
    fitted = trained(spark, folder)
    scored = live.scored(live.timed(_weather_stream(spark, folder)), fitted.model, fitted.score)
    target = _run(sinks.weather_updates(scored), "scored-feed", "json")
    return _without_numbers(spark.read.schema(FEED).json(target))


def _warned(spark, folder: str) -> DataFrame:
    stream = rules.fixed_warnings(live.timed(_weather_stream(spark, folder)))
    return _without_zone(spark.read.parquet(_run(stream, "warnings")))


def _rule_alerts(spark, folder: str) -> DataFrame:
    def current_rules(batch: DataFrame) -> DataFrame:
        tables = driver_tables(spark, folder)
        return rules.placed_rules(tables.alerts, tables.users, batch)

    table = CommittedTable(spark, shared_folder(spark, "rule-alerts"), live.TRIPS)
    live.rule_alerts(
        _weather_stream(spark, folder), current_rules, table, shared_folder(spark, "rule-alerts-state")
    ).awaitTermination()
    return (
        _without_zone(table.rows())
        .groupBy("alert_id", "metric", "threshold")
        .agg(
            F.sum("trips").alias("trips"),
            F.min("first_tripped_at").alias("first_tripped_at"),
            F.max("last_tripped_at").alias("last_tripped_at"),
            F.max("peak").alias("peak"),
        )
    )


def _flagged(spark, folder: str) -> DataFrame:
    """Readings with whether any rule of their location trips, as a stream-static join."""
    tables = driver_tables(spark, folder)
    floors = rules.rule_floors(rules.placed_rules(tables.alerts, tables.users))
    return spark.read.parquet(_run(rules.flagged(_weather_stream(spark, folder), floors), "flagged"))


TICK_COLUMNS = ("tick_start", "tick_end", "location", "n", "data_id", "temperature")


def _keyed(spark, stream: DataFrame, start, columns: str, late: str, land=lambda part: None):
    """What a stream with state of its own gives, and what came too late for it; ``land`` adds
    files between its runs."""
    table, side = (
        CommittedTable(spark, shared_folder(spark, "keyed"), names) for names in (columns, late)
    )
    held = Versions(spark, shared_folder(spark, "held"), columns)
    state = shared_folder(spark, "keyed-state")
    for part in range(PARTS):
        if land(part) is None and part:
            break
        start(stream, table, side, held, state).awaitTermination()
    return table.rows(), side.rows()


def _ticks(spark, folder: str) -> DataFrame:
    """Closed ticks only: the last ones stay open behind the watermark."""
    stream = _weather_stream(spark, folder)
    closed, _ = _keyed(spark, stream, live.closed_ticks, live.TICKS, schemas.WEATHER_DATA)
    return _without_zone(closed.select(*TICK_COLUMNS))


# Readings land by the day, in four parts; some arrive a part late, and half of those twice.
PARTS = 4
DELAYED, TWICE = 50, 100


def _in_parts(spark, folder: str, start, columns: str, late: str):
    weather = driver_tables(spark, folder).weather
    row = F.col("data_id")
    part = F.floor((F.dayofmonth("recorded_at") - 1) / 8).cast("int")
    arrives = F.least(part + (row % DELAYED == 0).cast("int"), F.lit(PARTS - 1))
    twice = weather.where(row % TWICE == 0).withColumn("_arrives", F.lit(PARTS - 1))
    landed = weather.withColumn("_arrives", arrives).unionByName(twice)
    landing = shared_folder(spark, "parts")

    def land(number: int) -> bool:
        own = landed.where(F.col("_arrives") == number).drop("_arrives")
        own.coalesce(1).write.mode("append").parquet(landing)
        return True

    columns_in = weather.schema
    spark.createDataFrame([], columns_in).write.parquet(landing)
    stream = spark.readStream.schema(columns_in).parquet(landing)
    return _keyed(spark, stream, start, columns, late, land)


def _ticks_in_parts(spark, folder: str) -> DataFrame:
    closed, late = _in_parts(
        spark, folder, live.closed_ticks, live.TICKS, schemas.WEATHER_DATA
    )
    return _without_zone(
        closed.select(*TICK_COLUMNS, F.lit(False).alias("is_late")).unionByName(
            late.select("location", "data_id", "temperature", F.lit(True).alias("is_late")),
            allowMissingColumns=True,
        )
    )


def _arrivals_in_parts(spark, folder: str) -> DataFrame:
    arrived, late = _in_parts(spark, folder, live.first_arrivals, live.ARRIVALS, live.ARRIVALS)
    return _without_zone(
        arrived.withColumn("is_late", F.lit(False)).unionByName(
            late.withColumn("is_late", F.lit(True))
        )
    )


def _first_seen(spark, folder: str) -> DataFrame:
    """The stream of readings sent twice, without the repeats."""
    first = _weather_stream(spark, folder)
    again = first.withColumn("data_id", -F.col("data_id"))
    stream = live.without_repeats(first.unionByName(again))
    target = _run(stream.select("location", "recorded_at"), "first-seen")
    return _without_zone(spark.read.parquet(target))


def _new_users(spark, folder: str) -> DataFrame:
    customers = _stream(spark, folder, "customer", CUSTOMER)
    stream = users_from(customers, driver_table(spark, folder, "nation", NATION))
    return spark.read.schema(FEED).json(_run(sinks.users_added(stream), "new-users", "json"))


def _new_alerts(spark, folder: str) -> DataFrame:
    stream = alerts_from(_stream(spark, folder, "orders", ORDERS))
    return spark.read.schema(FEED).json(_run(sinks.alerts_created(stream), "new-alerts", "json"))


def _live(spark, folder: str, stream: DataFrame, fitted=None):
    """The tables of a live update, and a function that runs it over what there is to take."""
    named = {name: shared_folder(spark, f"live-{name}") for name in ("table", "latest", "feed")}
    state = shared_folder(spark, "live-state")
    table, feed = readings_table(spark, named["table"]), feed_table(spark, named["feed"])
    latest = LatestReadings(spark, named["latest"])

    def current_locations() -> DataFrame:
        return aggregates.locations_of(driver_tables(spark, folder).users)

    def current_rules(batch: DataFrame) -> DataFrame:
        tables = driver_tables(spark, folder)
        return rules.placed_rules(tables.alerts, tables.users, batch)

    def run() -> None:
        live.live_update(
            stream,
            current_locations,
            current_rules,
            fitted.model if fitted else None,
            fitted.score if fitted else None,
            table,
            feed,
            state,
            every=None,
            latest=latest,
        ).awaitTermination()

    return table, latest, feed, run


def _live_update(with_model: bool):
    def run(spark, folder: str) -> DataFrame:
        fitted = trained(spark, folder) if with_model else None
        stream = live.timed(_weather_stream(spark, folder))
        _, _, feed, update = _live(spark, folder, stream, fitted)
        update()
        return _without_numbers(feed.rows())

    return run


# Files that a micro-batch takes. Answers land in as many tasks for each of two micro-batches.
FILES = 12


def _from_landed_answers(spark, folder: str):
    """The live update over landed JSON answers, a quarter of the files a micro-batch, stopped when
    half of them are taken and resumed. The second half is late: its readings lie between those of
    the first."""
    answers = landed_payloads(driver_tables(spark, folder).weather)
    landing = shared_folder(spark, "landing")

    def land(rows: DataFrame) -> None:
        rows.repartition(2 * FILES, "reading_id").write.mode("append").option(
            "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        ).json(landing)

    land(answers.where("reading_id % 2 = 0"))
    stream = payloads.readings(payloads.landed_stream(spark, landing, files_per_batch=FILES))
    table, latest, feed, update = _live(spark, folder, stream)
    update()
    land(answers.where("reading_id % 2 = 1"))
    update()
    return table, latest, feed


def _landed_table(spark, folder: str) -> DataFrame:
    """Stored rows, each day's files compacted but for the last one's."""
    table, _, _ = _from_landed_answers(spark, folder)
    table.compact(table.rows().agg(F.max("recorded_date")).first()[0], most_files=1)
    rows = _without_zone(table.rows())
    return rows.withColumn("recorded_date", F.col("recorded_date").cast("string"))


def _landed_latest(spark, folder: str) -> DataFrame:
    return _without_zone(_from_landed_answers(spark, folder)[1].rows())


def _put_together(tripped: DataFrame) -> DataFrame:
    """One row per alert and metric. Times are compared as such and not as text, so that rows are
    hashed and not sorted."""
    return (
        tripped.select(F.from_json("payload", TRIPPED).alias("own"))
        .groupBy("own.alert_id", "own.metric")
        .agg(
            F.sum("own.trips").alias("trips"),
            F.max("own.peak").alias("peak"),
            F.max("own.timestamp").alias("last_at"),
        )
        .select(
            F.lit("alert_tripped").alias("event"),
            "alert_id",
            "metric",
            "trips",
            "peak",
            iso_text(F.col("last_at")).alias("last_at"),
        )
    )


def _landed_feed(spark, folder: str) -> DataFrame:
    """The feed, with the alerts of all micro-batches put together."""
    _, _, feed = _from_landed_answers(spark, folder)
    rows = feed.rows()
    tripped = _put_together(rows.where("event = 'alert_tripped'"))
    others = rows.where("event != 'alert_tripped'").select("event", "payload")
    return others.unionByName(tripped, allowMissingColumns=True)


def _kept_latest(spark, folder: str) -> DataFrame:
    """The latest readings, merged from three batches, one of them twice."""
    latest = LatestReadings(spark, shared_folder(spark, "latest"))
    weather = driver_tables(spark, folder).weather
    timed = weather.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    for part in (2, 0, 1, 0):
        latest.merge(timed.where(F.col("data_id") % 3 == part), f"part-{part}")
    return _without_zone(latest.rows())


def _q6_kept(spark, folder: str) -> DataFrame:
    tables = driver_tables(spark, folder)
    return profiles.recommendations(tables, _kept_latest(spark, folder))


def _q7_kept(spark, folder: str) -> DataFrame:
    tables = driver_tables(spark, folder)
    return alerts.tripped_alerts(tables, _kept_latest(spark, folder))


def _t5_kept(spark, folder: str) -> DataFrame:
    tables = driver_tables(spark, folder)
    return dashboard.current_reading(tables, PLACE, _kept_latest(spark, folder))


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
USERS_ADDED = f"""
SELECT 'user_added' AS event,
       '{{"username":"' || username || '","location":"' || location || '","timestamp":"'
       || {ISO.format("created_at")} || '"}}' AS payload
FROM users
"""
ALERTS_CREATED = f"""
SELECT 'alert_created' AS event,
       '{{"user_id":' || CAST(user_id AS VARCHAR) || ',"alert_type":"' || alert_type
       || '","severity":"' || severity || '","message":"' || message || '","timestamp":"'
       || {ISO.format("created_at")} || '"}}' AS payload
FROM weather_alerts
"""
END = """'"}}'"""
PREDICTED_END = f"""
CASE WHEN {KNOWN}
     THEN '"}},"prediction":{{"is_predicted":true,"timestamp":"'
          || {ISO.format("recorded_at + INTERVAL 1 HOUR")} || '"}}}}'
     ELSE {END} END
"""


def _updates_sql(end: str) -> str:
    return f"""
SELECT 'weather_update' AS event,
       '{{"location":"' || location || '","data":{{"temperature":' || CAST(temperature AS VARCHAR)
       || ',"humidity":' || CAST(humidity AS VARCHAR) || ',"pressure":'
       || CAST(pressure AS VARCHAR) || ',"wind_speed":' || CAST(wind_speed AS VARCHAR)
       || ',"condition":"' || weather_condition || '","location":"' || location
       || '","timestamp":"' || {ISO.format("recorded_at")} || {end} AS payload
FROM weather_data
"""


RAISED_SQL = f"""
UNION ALL
SELECT 'warning', '{{"location":"' || location || '","title":"Heat Warning",'
       || '"message":"Extreme temperature detected!","level":"warning","timestamp":"'
       || {ISO.format("recorded_at")} || '"}}'
FROM weather_data WHERE temperature > 35
UNION ALL
SELECT 'warning', '{{"location":"' || location || '","title":"Wind Warning",'
       || '"message":"High wind conditions!","level":"danger","timestamp":"'
       || {ISO.format("recorded_at")} || '"}}'
FROM weather_data WHERE wind_speed > 50
UNION ALL
SELECT 'alert_tripped',
       '{{"alert_id":' || CAST(alert_id AS VARCHAR) || ',"user_id":' || CAST(user_id AS VARCHAR)
       || ',"location":"' || location || '","severity":"' || severity || '","message":"'
       || message || '","metric":"' || metric || '","threshold":' || CAST(threshold AS VARCHAR)
       || ',"trips":' || CAST(trips AS VARCHAR) || ',"peak":' || CAST(peak AS VARCHAR)
       || ',"timestamp":"' || {ISO.format("last_tripped_at")} || '"}}'
FROM trips
"""
TICKS_SQL = f"""
, ticks AS (
  SELECT time_bucket(INTERVAL 2 MINUTES, recorded_at) AS tick_start, location, count(*) AS n,
         max_by(data_id, (recorded_at, data_id)) AS data_id,
         max_by(temperature, (recorded_at, data_id)) AS temperature
  FROM weather_data GROUP BY 1, 2
)
SELECT tick_start, tick_start + INTERVAL 2 MINUTES AS tick_end, location, n, data_id, temperature
FROM ticks
"""
WARNINGS_SQL = """
SELECT data_id, location, temperature, wind_speed, recorded_at,
       'Heat Warning' AS title, 'Extreme temperature detected!' AS message, 'warning' AS level
FROM weather_data WHERE temperature > 35
UNION ALL
SELECT data_id, location, temperature, wind_speed, recorded_at,
       'Wind Warning', 'High wind conditions!', 'danger'
FROM weather_data WHERE wind_speed > 50
"""

register_all(
    {
        "t3_fixed_warnings_batch": (lambda t: rules.fixed_warnings(t.weather), WARNINGS_SQL),
        "t5_current_reading": (
            lambda t: dashboard.current_reading(t, PLACE),
            f", {LATEST} SELECT {READING_COLUMNS} FROM latest WHERE location = '{PLACE}'",
        ),
        "t6_ticks_batch": (
            lambda t: _without_zone(
                live.latest_per_tick(
                    t.weather.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
                ).select(*TICK_COLUMNS)
            ),
            TICKS_SQL,
        ),
    }
)
register(
    "t1_stored_stream",
    _stored,
    f"""
    SELECT {READING_COLUMNS}, CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS recorded_date
    FROM weather_data WHERE location IN (SELECT location FROM users)
    """,
)
register("t2_scored_stream", _scored, _updates_sql(PREDICTED_END))
register("t3_fixed_warnings_stream", _warned, WARNINGS_SQL)
register(
    "t4_rule_alerts_stream",
    _rule_alerts,
    f"""
    , {TRIPS}
    SELECT alert_id, metric, threshold, trips, first_tripped_at, last_tripped_at, peak FROM trips
    """,
)
register(
    "t6_ticks_stream",
    _ticks,
    f"""
    {TICKS_SQL}
    WHERE tick_start + INTERVAL 2 MINUTES
          <= (SELECT max(recorded_at) FROM weather_data) - INTERVAL 10 MINUTES
    """,
)
register(
    "t7_without_repeats_stream",
    _first_seen,
    "SELECT DISTINCT location, recorded_at FROM weather_data",
)
register("t8_new_users_stream", _new_users, USERS_ADDED)
register("t8_new_alerts_stream", _new_alerts, ALERTS_CREATED)
register(
    "j10_stream_static_rules",
    _flagged,
    f"""
    , {LIMITS},
    floors AS (
      SELECT location, count(DISTINCT alert_id) AS n_rules,
             min(threshold) FILTER (WHERE metric = 'temperature') AS temperature_floor,
             min(threshold) FILTER (WHERE metric = 'wind_speed') AS wind_speed_floor,
             min(threshold) FILTER (WHERE metric = 'precipitation') AS precipitation_floor
      FROM limits GROUP BY location
    )
    SELECT data_id, w.location, recorded_at, coalesce(n_rules, 0) AS n_rules,
           coalesce(temperature >= temperature_floor, false)
             OR coalesce(wind_speed >= wind_speed_floor, false)
             OR coalesce(precipitation >= precipitation_floor, false) AS trips_a_rule
    FROM weather_data w LEFT JOIN floors f ON w.location = f.location
    """,
)
register(
    "q11_live_update",
    _live_update(with_model=False),
    f", {TRIPS} {_updates_sql(END)} {RAISED_SQL}",
)
register(
    "q11_live_update_scored",
    _live_update(with_model=True),
    f", {TRIPS} {_updates_sql(PREDICTED_END)} {RAISED_SQL}",
)

# The derived tables with the landed answers in place of the readings.
LANDED = f"""
, {PARSED},
stored AS (
  SELECT * EXCLUDE (is_fallback) FROM readings WHERE location IN (SELECT location FROM users)
)
"""
register(
    "t1_landed_answers",
    _landed_table,
    f"""
    {LANDED}
    SELECT {READING_COLUMNS}, CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS recorded_date
    FROM stored
    """,
)
register(
    "t1_latest_of_landed_answers",
    _landed_latest,
    f"{LANDED}, {LATEST.replace('weather_data', 'stored')} SELECT {READING_COLUMNS} FROM latest",
)
register(
    "q11_landed_answers",
    _landed_feed,
    f"""
    {LANDED}, {TRIPS.replace('weather_data', 'stored')},
    feed AS (
      {(_updates_sql(END) + RAISED_SQL).replace('weather_data', 'stored')}
    )
    SELECT event, payload, CAST(NULL AS BIGINT) AS alert_id, CAST(NULL AS VARCHAR) AS metric,
           CAST(NULL AS BIGINT) AS trips, CAST(NULL AS DOUBLE) AS peak,
           CAST(NULL AS VARCHAR) AS last_at
    FROM feed WHERE event <> 'alert_tripped'
    UNION ALL
    SELECT 'alert_tripped', NULL, alert_id, metric, trips, peak, {ISO.format("last_tripped_at")}
    FROM trips
    """,
)
register_same("w2_kept_latest", _kept_latest, "w2_latest_per_location")
register_same("q6_kept_latest", _q6_kept, "q6_recommendations")
register_same("q7_kept_latest", _q7_kept, "q7_tripped_alerts")
register_same("t5_kept_latest", _t5_kept, "t5_current_reading")

# Readings by the part they arrive in, with the newest time of the parts before.
ARRIVED = f"""
, arrived AS (
  SELECT *, least(CAST(floor((day(recorded_at) - 1) / 8) AS INTEGER)
                  + CASE WHEN data_id % {DELAYED} = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS part
  FROM weather_data
  UNION ALL
  SELECT *, {PARTS - 1} FROM weather_data WHERE data_id % {TWICE} = 0
),
ends AS (SELECT part, max(recorded_at) AS newest FROM arrived GROUP BY part),
judged AS (
  SELECT a.*, time_bucket(INTERVAL 2 MINUTES, recorded_at) AS tick_start,
         (SELECT max(newest) FROM ends e WHERE e.part < a.part) - INTERVAL 10 MINUTES AS behind
  FROM arrived a
)
"""
register(
    "t6_ticks_in_parts",
    _ticks_in_parts,
    f"""
    {ARRIVED},
    sorted_out AS (
      SELECT *, coalesce(tick_start + INTERVAL 2 MINUTES <= behind, false) AS is_late FROM judged
    )
    SELECT tick_start, tick_start + INTERVAL 2 MINUTES AS tick_end, location, count(*) AS n,
           max_by(data_id, (recorded_at, data_id)) AS data_id,
           max_by(temperature, (recorded_at, data_id)) AS temperature, false AS is_late
    FROM sorted_out WHERE NOT is_late GROUP BY tick_start, location
    HAVING tick_start + INTERVAL 2 MINUTES
           <= (SELECT max(recorded_at) FROM weather_data) - INTERVAL 10 MINUTES
    UNION ALL
    SELECT NULL, NULL, location, NULL, data_id, temperature, true FROM sorted_out WHERE is_late
    """,
)
register(
    "t7_arrivals_in_parts",
    _arrivals_in_parts,
    f"""
    {ARRIVED}
    SELECT location, recorded_at,
           arg_min(coalesce(recorded_at <= behind, false), part) AS is_late
    FROM judged GROUP BY location, recorded_at
    """,
)
