"""Scans, inserts, filters, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.checks.base_views import (
    FORMS,
    LATEST,
    LIMITS,
    PARSED,
    SIGN_UPS,
    TRIPS,
    WISHES,
    landed_payloads,
    preference_requests,
    sign_ups,
)
from skyvane.checks.registry import AS_OF, PLACE, register, register_all
from skyvane.functions import text
from skyvane.operators import (
    aggregates,
    joins,
    lookups,
    places,
    quality,
    recommend,
    rules,
    topk,
    windows,
)
from skyvane.session import shared_folder
from skyvane.sources import inserts, payloads, sinks
from skyvane.sources.tables import driver_tables

READING_COLUMNS = (
    "data_id, location, temperature, humidity, pressure, wind_speed, weather_condition, "
    "precipitation, recorded_at"
)


# Sources and sinks ---------------------------------------------------------------------

def _some_adrift(children):
    """All children, a seventh of the users replaced by ones that do not exist."""
    user = F.col("user_id")
    return children.withColumn("user_id", F.when(user % 7 == 3, -user).otherwise(user))


def _with_roving(readings):
    """All readings, one in forty of them at roving stations of ten readings at most."""
    row = F.col("data_id")
    station = F.concat(F.lit("ROVING_"), F.floor(row / 400).cast("string"))
    return readings.withColumn("location", F.when(row % 40 == 0, station).otherwise(F.col("location")))


register_all(
    {
        "s1_scan_users": (lambda t: t.users, "SELECT * FROM users"),
        "s1_scan_weather_data": (lambda t: t.weather, "SELECT * FROM weather_data"),
        "s1_scan_user_activities": (
            lambda t: t.activities.drop("notes"),
            "SELECT * EXCLUDE (notes) FROM user_activities",
        ),
        "s1_scan_weather_alerts": (lambda t: t.alerts, "SELECT * FROM weather_alerts"),
        "s2_parse_payloads": (
            lambda t: payloads.parsed(landed_payloads(t.weather)),
            f", {PARSED} SELECT * FROM parsed",
        ),
        "s3_fallback_readings": (
            lambda t: payloads.readings(landed_payloads(t.weather)),
            f", {PARSED} SELECT * FROM readings",
        ),
        "s5_history_query": (
            lambda t: lookups.history(t.weather, PLACE, 168, AS_OF),
            f"""
            SELECT data_id, recorded_at, temperature, humidity, pressure, wind_speed,
                   CAST(hour(recorded_at) AS INTEGER) AS hour,
                   CAST(dayofweek(recorded_at) AS INTEGER) AS day_of_week,
                   CAST(month(recorded_at) AS INTEGER) AS month
            FROM weather_data
            WHERE location = '{PLACE}'
              AND recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS
            """,
        ),
        "s6_insert_unique_accepted": (
            lambda t: inserts.insert_unique(sign_ups(t), t.users).valid,
            f", {SIGN_UPS} SELECT * EXCLUDE (reason) FROM decided WHERE reason IS NULL",
        ),
        "s6_insert_unique_refused": (
            lambda t: inserts.insert_unique(sign_ups(t), t.users).quarantine,
            f", {SIGN_UPS} SELECT * FROM decided WHERE reason IS NOT NULL",
        ),
        "s7_insert_new_readings": (
            lambda t: inserts.insert_new_readings(
                t.weather.unionByName(
                    t.weather.withColumn("data_id", F.col("data_id") + 10_000_000_000)
                )
            ),
            f"""
            SELECT {READING_COLUMNS} FROM weather_data
            QUALIFY row_number() OVER (PARTITION BY location, recorded_at ORDER BY data_id) = 1
            """,
        ),
        "s8_new_alerts": (
            lambda t: inserts.new_alerts(
                t.activities.select(
                    "user_id",
                    F.lit("Temperature").alias("alert_type"),
                    F.when(F.col("duration_minutes") > 60, "High")
                    .otherwise("Low")
                    .alias("severity"),
                    F.concat(F.lit("request "), F.col("activity_id").cast("string")).alias(
                        "message"
                    ),
                    F.when(F.col("satisfaction_rating") == 1, F.lit(None))
                    .when(F.col("satisfaction_rating") == 2, "hot")
                    .otherwise(F.concat(F.col("duration_minutes").cast("string"), F.lit(".5")))
                    .alias("temp_threshold"),
                ),
                AS_OF,
            ),
            f"""
            SELECT user_id, 'Temperature' AS alert_type,
                   CASE WHEN duration_minutes > 60 THEN 'High' ELSE 'Low' END AS severity,
                   'request ' || CAST(activity_id AS VARCHAR) AS message,
                   '{{"temperature":'
                     || CASE WHEN satisfaction_rating <= 2 THEN '30.0'
                             ELSE CAST(duration_minutes AS VARCHAR) || '.5' END
                     || ',"wind_speed":50.0,"precipitation":10.0}}' AS trigger_conditions,
                   true AS is_active, TIMESTAMP '{AS_OF}' AS created_at
            FROM user_activities
            """,
        ),
        "s9_column_defaults": (
            lambda t: inserts.with_defaults(
                t.alerts.select(
                    "alert_id",
                    F.when(F.col("severity") != "Low", F.col("is_active")).alias("is_active"),
                    F.when(F.col("alert_type") != "Rain", F.col("created_at")).alias("created_at"),
                ),
                AS_OF,
            ),
            f"""
            SELECT alert_id,
                   CASE WHEN severity <> 'Low' THEN is_active ELSE true END AS is_active,
                   CASE WHEN alert_type <> 'Rain' THEN created_at ELSE TIMESTAMP '{AS_OF}' END
                     AS created_at
            FROM weather_alerts
            """,
        ),
        "s10_new_ids": (
            lambda t: inserts.with_new_ids(t.users.drop("user_id"), t.users, "user_id")
            .agg(
                F.count("*").alias("n_rows"),
                F.count_distinct("user_id").alias("n_ids"),
                F.min("user_id").alias("lowest"),
            )
            .select("n_rows", "n_ids", "lowest"),
            "SELECT count(*) AS n_rows, count(*) AS n_ids, max(user_id) + 1 AS lowest FROM users",
        ),
        "s11_feed_users_added": (
            lambda t: sinks.users_added(t.users),
            """
            SELECT 'user_added' AS event,
                   '{"username":"' || username || '","location":"' || location
                   || '","timestamp":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}'
                   AS payload
            FROM users
            """,
        ),
        "s11_feed_alerts_created": (
            lambda t: sinks.alerts_created(t.alerts),
            """
            SELECT 'alert_created' AS event,
                   '{"user_id":' || CAST(user_id AS VARCHAR) || ',"alert_type":"' || alert_type
                   || '","severity":"' || severity || '","message":"' || message
                   || '","timestamp":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}'
                   AS payload
            FROM weather_alerts
            """,
        ),
    }
)


def _appended(spark, folder: str) -> DataFrame:
    """Append all readings in two batches and read the table back."""
    table = shared_folder(spark, "weather_data")
    parsed = payloads.readings(landed_payloads(driver_tables(spark, folder).weather))
    for is_fallback in (False, True):
        sinks.append_readings(parsed.where(F.col("is_fallback") == is_fallback), table)
    return _read_back(sinks.stored_readings(spark, table))


def _compacted(spark, folder: str) -> DataFrame:
    """Append all readings from tasks that each hold every day, compact the table and read it back."""
    table = shared_folder(spark, "weather_data")
    parsed = payloads.readings(landed_payloads(driver_tables(spark, folder).weather))
    sinks.append_readings(parsed.repartition(16, "data_id"), table)
    compacted = shared_folder(spark, "weather_data")
    sinks.compact_readings(sinks.stored_readings(spark, table), compacted)
    return _read_back(sinks.stored_readings(spark, compacted))


def _read_back(stored: DataFrame) -> DataFrame:
    return stored.withColumns(
        {
            "recorded_at": F.col("recorded_at").cast("timestamp_ntz"),
            "recorded_date": F.col("recorded_date").cast("string"),
        }
    )


STORED_SQL = (
    f", {PARSED} SELECT {READING_COLUMNS},"
    " CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS recorded_date FROM readings"
)
register("s4_append_readings", _appended, STORED_SQL)
register("s4_compacted_readings", _compacted, STORED_SQL)


# Projections and filters ---------------------------------------------------------------

register_all(
    {
        "p1_column_projection": (
            lambda t: t.weather.select(
                "location", "temperature", "weather_condition", "recorded_at"
            ),
            "SELECT location, temperature, weather_condition, recorded_at FROM weather_data",
        ),
        "p2_star_projection": (
            lambda t: t.users.alias("u").select("u.*"),
            "SELECT u.* FROM users u",
        ),
        "p3_aliased_columns": (
            lambda t: t.weather.select(
                "data_id",
                (F.col("temperature") * 9 / 5 + 32).alias("fahrenheit"),
                F.hour("recorded_at").alias("hour"),
            ),
            """
            SELECT data_id, temperature * 9 / 5 + 32 AS fahrenheit,
                   CAST(hour(recorded_at) AS INTEGER) AS hour
            FROM weather_data
            """,
        ),
        "f1_user_by_key": (
            lambda t: lookups.of_user(t.users, 42),
            "SELECT * FROM users WHERE user_id = 42",
        ),
        "f2_readings_at_location": (
            lambda t: lookups.at_location(t.weather, PLACE),
            f"SELECT {READING_COLUMNS} FROM weather_data WHERE location = '{PLACE}'",
        ),
        "f3_active_alerts": (
            lambda t: lookups.active(t.alerts),
            "SELECT * FROM weather_alerts WHERE is_active",
        ),
        "f4_readings_since": (
            lambda t: lookups.since(t.weather, AS_OF, 168),
            f"""
            SELECT {READING_COLUMNS} FROM weather_data
            WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS
            """,
        ),
        "f5_location_and_window": (
            lambda t: lookups.since(lookups.at_location(t.weather, PLACE), AS_OF, 24),
            f"""
            SELECT {READING_COLUMNS} FROM weather_data
            WHERE location = '{PLACE}'
              AND recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS
            """,
        ),
        "f6_bound_parameters": (
            lambda t: t.weather.sparkSession.sql(
                "SELECT data_id, location, temperature FROM {readings} "
                "WHERE temperature >= ? AND weather_condition = ?",
                args=[30.0, "Sunny"],
                readings=t.weather,
            ),
            """
            SELECT data_id, location, temperature FROM weather_data
            WHERE temperature >= 30.0 AND weather_condition = 'Sunny'
            """,
        ),
        "f7_enough_history": (
            lambda t: lookups.with_enough_history(_with_roving(t.weather)).select(
                "data_id", "location"
            ),
            """
            , placed AS (
              SELECT data_id,
                     CASE WHEN data_id % 40 = 0
                          THEN 'ROVING_' || CAST(data_id // 400 AS VARCHAR)
                          ELSE location END AS location
              FROM weather_data
            )
            SELECT data_id, location FROM placed
            WHERE location IN (SELECT location FROM placed GROUP BY location
                               HAVING count(*) >= 20)
            """,
        ),
        "f8_preference_ranges": (
            lambda t: _judged_forms(preference_requests(t)),
            f"""
            , {FORMS}
            SELECT user_id,
                   CASE WHEN temperature_min NOT BETWEEN -10 AND 40 THEN 'minimum out of bounds'
                        WHEN temperature_max NOT BETWEEN -10 AND 40 THEN 'maximum out of bounds'
                        WHEN temperature_min >= temperature_max THEN 'minimum not below maximum'
                   END AS reason
            FROM bounds
            """,
        ),
        "f9_required_fields": (
            lambda t: quality.split(
                sign_ups(t), quality.required_fields("username", "email", "location")
            ).quarantine.select("request_id", "reason"),
            f"""
            , {SIGN_UPS}
            SELECT request_id,
                   CASE WHEN trim(username) = '' THEN 'username is missing'
                        ELSE 'email is missing' END AS reason
            FROM sign_ups WHERE trim(username) = '' OR email IS NULL
            """,
        ),
        "f10_alert_domains": (
            lambda t: quality.split(
                t.alerts.select(
                    "alert_id",
                    F.when(F.col("severity") == "Critical", "Extreme")
                    .otherwise(F.lower("severity"))
                    .alias("severity"),
                    F.when(F.col("message").endswith("7"), "Fog")
                    .otherwise(F.col("alert_type"))
                    .alias("alert_type"),
                ),
                quality.alert_domains(),
            ).quarantine.select("alert_id", "reason"),
            """
            SELECT alert_id, CASE WHEN severity = 'Critical' THEN 'unknown severity'
                                  ELSE 'unknown alert type' END AS reason
            FROM weather_alerts WHERE severity = 'Critical' OR message LIKE '%7'
            """,
        ),
        "f10_activity_domains": (
            lambda t: quality.split(
                t.activities.select(
                    "activity_id",
                    F.when(F.col("duration_minutes") == 30, "napping")
                    .otherwise(F.col("activity_type"))
                    .alias("activity_type"),
                    (F.col("satisfaction_rating") + 1).alias("satisfaction_rating"),
                ),
                quality.activity_domains(),
            ).quarantine.select("activity_id", "reason"),
            """
            SELECT activity_id, CASE WHEN duration_minutes = 30 THEN 'unknown activity'
                                     ELSE 'rating out of bounds' END AS reason
            FROM user_activities WHERE duration_minutes = 30 OR satisfaction_rating = 5
            """,
        ),
        "f11_text_contains": (
            lambda t: t.weather.where(
                text.contains_text(F.col("weather_condition"), "Cloud")
                | text.contains_text(F.col("weather_condition"), "Sunny")
            ).select("data_id", "weather_condition"),
            """
            SELECT data_id, weather_condition FROM weather_data
            WHERE contains(weather_condition, 'Cloud') OR contains(weather_condition, 'Sunny')
            """,
        ),
        "f12_not_yet_tracked": (
            lambda t: lookups.not_tracked(
                places.default_locations(t.users.sparkSession).unionByName(
                    t.weather.select("location").distinct()
                ),
                aggregates.locations_of(t.users),
            ),
            """
            SELECT location FROM (
              SELECT DISTINCT location FROM weather_data
              UNION ALL SELECT unnest(['London', 'New York', 'Tokyo', 'Paris', 'Sydney'])
            ) WHERE location NOT IN (SELECT location FROM users)
            """,
        ),
        "f12_membership": (
            lambda t: recommend.with_preferences(t.users).select(
                "user_id",
                F.coalesce(
                    F.array_contains("wishes.preferred_activities", "walking"), F.lit(False)
                ).alias("likes_walking"),
            ),
            """
            SELECT user_id, coalesce(contains(preferences, '"walking"'), false) AS likes_walking
            FROM users
            """,
        ),
    }
)


def _judged_forms(requests: DataFrame) -> DataFrame:
    stored = recommend.with_preferences(inserts.preference_forms(requests))
    checked = quality.split(
        stored,
        quality.preference_range(
            F.col("wishes.temperature_min"), F.col("wishes.temperature_max")
        ),
    )
    return checked.valid.withColumn("reason", F.lit(None).cast("string")).unionByName(
        checked.quarantine
    ).select("user_id", "reason")


# Joins ---------------------------------------------------------------------------------

register_all(
    {
        "j1_inner_activities_users": (
            lambda t: joins.activities_with_users(t.activities, t.users).select(
                "activity_id", "user_id", "username", "activity_type"
            ),
            """
            SELECT a.activity_id, a.user_id, u.username, a.activity_type
            FROM user_activities a JOIN users u ON a.user_id = u.user_id
            """,
        ),
        "j2_left_users_activities": (
            lambda t: joins.users_with_activities(
                t.users, t.activities.select("user_id", "activity_id", "activity_type")
            ).select("user_id", "username", "activity_id", "activity_type"),
            """
            SELECT u.user_id, u.username, a.activity_id, a.activity_type
            FROM users u LEFT JOIN user_activities a ON a.user_id = u.user_id
            """,
        ),
        "j3_left_users_active_alerts": (
            lambda t: joins.users_with_active_alerts(
                t.users.select("user_id", "username"), t.alerts
            ).select("user_id", "username", "alert_id", "severity"),
            """
            SELECT u.user_id, u.username, a.alert_id, a.severity
            FROM users u LEFT JOIN weather_alerts a ON a.user_id = u.user_id AND a.is_active
            """,
        ),
        "j4_counts_without_fan_out": (
            lambda t: aggregates.users_with_counts(t.users, t.activities, t.alerts).select(
                "user_id", "activity_count", "active_alert_count"
            ),
            """
            , done AS (SELECT user_id, count(*) AS n FROM user_activities GROUP BY 1),
            armed AS (SELECT user_id, count(*) AS n FROM weather_alerts WHERE is_active GROUP BY 1)
            SELECT user_id, coalesce(done.n, 0) AS activity_count,
                   coalesce(armed.n, 0) AS active_alert_count
            FROM users LEFT JOIN done USING (user_id) LEFT JOIN armed USING (user_id)
            """,
        ),
        "j5_users_latest_reading": (
            lambda t: joins.users_with_latest(
                t.users.select("user_id", "location"), windows.latest_per_location(t.weather, "temperature", "weather_condition"),
            ).select("user_id", "location", "data_id", "temperature", "weather_condition"),
            f"""
            , {LATEST}
            SELECT u.user_id, u.location, l.data_id, l.temperature, l.weather_condition
            FROM users u LEFT JOIN latest l ON u.location = l.location
            """,
        ),
        "j6_tracked_readings": (
            lambda t: joins.tracked_readings(
                t.weather, aggregates.locations_of(t.users)
            ).select("data_id", "location"),
            """
            SELECT data_id, location FROM weather_data
            WHERE location IN (SELECT location FROM users)
            """,
        ),
        "j7_rules_on_latest_reading": (
            lambda t: rules.tripped_on_latest(
                t.alerts, t.users, windows.latest_per_location(t.weather, *rules.METRICS)
            ).select("alert_id", "data_id", "metric", "value", "threshold"),
            f"""
            , {LATEST}, {LIMITS}
            SELECT l.alert_id, r.data_id, l.metric, r.level AS value, l.threshold
            FROM limits l
            JOIN levels r ON l.location = r.location AND l.metric = r.metric
                         AND r.level >= l.threshold
            WHERE r.data_id IN (SELECT data_id FROM latest)
            """,
        ),
        "j7_rules_on_all_readings": (
            lambda t: rules.trip_history(
                rules.placed_rules(t.alerts, t.users), t.weather
            ).select(
                "alert_id",
                "metric",
                "threshold",
                "trips",
                "first_tripped_at",
                "last_tripped_at",
                "peak",
            ),
            f"""
            , {TRIPS}
            SELECT alert_id, metric, threshold, trips, first_tripped_at, last_tripped_at, peak
            FROM trips
            """,
        ),
        "j8_preferences_latest_reading": (
            lambda t: joins.users_with_latest(
                recommend.with_preferences(t.users).select(
                    "user_id", "location", F.col("wishes.temperature_max").alias("upper")
                ),
                windows.latest_per_location(t.weather, "temperature"),
            ).select(
                "user_id",
                F.when(F.col("temperature") > F.col("upper"), "above")
                .when(F.col("temperature") <= F.col("upper"), "within")
                .alias("against_maximum"),
            ),
            f"""
            , {LATEST}, {WISHES}
            SELECT w.user_id, CASE WHEN l.temperature > w.temperature_max THEN 'above'
                                   WHEN l.temperature <= w.temperature_max THEN 'within'
                              END AS against_maximum
            FROM wishes w LEFT JOIN latest l ON w.location = l.location
            """,
        ),
        "j9_orphans": (
            lambda t: joins.orphans(
                _some_adrift(t.activities), t.users, "user_activities", "activity_id"
            ).unionByName(
                joins.orphans(_some_adrift(t.alerts), t.users, "weather_alerts", "alert_id")
            ),
            """
            SELECT 'user_activities' AS child, activity_id AS child_id, -user_id AS user_id
            FROM user_activities WHERE user_id % 7 = 3
            UNION ALL
            SELECT 'weather_alerts', alert_id, -user_id
            FROM weather_alerts WHERE user_id % 7 = 3
            """,
        ),
    }
)


# Aggregates ----------------------------------------------------------------------------

FEATURE_COLUMNS = ["temperature", "humidity", "pressure", "wind_speed"]

register_all(
    {
        "a1_total_count": (
            lambda t: t.activities.agg(F.count("*").alias("total_activities")),
            "SELECT count(*) AS total_activities FROM user_activities",
        ),
        "a2_filtered_count": (
            lambda t: t.alerts.agg(F.count_if("is_active").alias("active_alerts")),
            "SELECT count(*) FILTER (WHERE is_active) AS active_alerts FROM weather_alerts",
        ),
        "a3_distinct_counts": (
            lambda t: t.activities.groupBy("user_id").agg(
                F.count_distinct("activity_type").alias("n_types"),
                F.count_distinct("weather_condition").alias("n_conditions"),
            ),
            """
            SELECT user_id, count(DISTINCT activity_type) AS n_types,
                   count(DISTINCT weather_condition) AS n_conditions
            FROM user_activities GROUP BY user_id
            """,
        ),
        "a4_group_with_dependents": (
            lambda t: t.users.join(aggregates.activity_counts(t.activities), "user_id", "left"),
            """
            SELECT u.*, c.activity_count
            FROM users u
            LEFT JOIN (SELECT user_id, count(*) AS activity_count FROM user_activities
                       GROUP BY user_id) c ON u.user_id = c.user_id
            """,
        ),
        "a5_distinct_locations": (
            lambda t: aggregates.locations_of(t.users),
            "SELECT DISTINCT location FROM users",
        ),
        "a6_group_sizes": (
            lambda t: aggregates.alert_counts(t.alerts),
            """
            SELECT user_id, count(*) AS alert_count,
                   count(*) FILTER (WHERE is_active) AS active_alert_count
            FROM weather_alerts GROUP BY user_id
            """,
        ),
        "a8_mean_and_deviation": (
            lambda t: aggregates.column_statistics(t.weather, FEATURE_COLUMNS).select(
                "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
            ),
            " UNION ALL ".join(
                f"SELECT '{column}' AS feature, round(avg({column}), 6) AS mean, "
                f"round(stddev_pop({column}), 6) AS std FROM weather_data"
                for column in FEATURE_COLUMNS
            ),
        ),
    }
)


# Windows, order, sets ------------------------------------------------------------------

NEXT = """
followed AS (
  SELECT *, lead(data_id) OVER w AS next_id, lead(temperature) OVER w AS next_temperature
  FROM weather_data
  WINDOW w AS (PARTITION BY location ORDER BY recorded_at, data_id)
)
"""

register_all(
    {
        "w1_next_reading": (
            lambda t: windows.with_next(
                t.weather.select("data_id", "location", "recorded_at", "temperature"),
                "location",
                ["data_id", "temperature"],
            )
            .where(F.col("next").isNotNull())
            .select(
                "data_id",
                "location",
                F.col("next.data_id").alias("next_id"),
                F.col("next.temperature").alias("next_temperature"),
            ),
            f"""
            , {NEXT}
            SELECT data_id, location, next_id, next_temperature FROM followed
            WHERE next_id IS NOT NULL
            """,
        ),
        "w2_latest_per_location": (
            lambda t: windows.latest_per_location(t.weather),
            f", {LATEST} SELECT {READING_COLUMNS} FROM latest",
        ),
        "w3_last_ten_activities": (
            lambda t: windows.newest_per(
                t.activities, "user_id", "activity_date", "activity_id", 10
            ).select("user_id", "activity_id", F.col("rank").cast("bigint").alias("rank")),
            """
            SELECT user_id, activity_id,
                   row_number() OVER (PARTITION BY user_id
                                      ORDER BY activity_date DESC, activity_id DESC) AS rank
            FROM user_activities QUALIFY rank <= 10
            """,
        ),
        "w4_last_five_readings": (
            lambda t: windows.newest_per(
                t.weather, "location", "recorded_at", "data_id", 5
            ).select("location", "data_id", F.col("rank").cast("bigint").alias("rank")),
            """
            SELECT location, data_id,
                   row_number() OVER (PARTITION BY location
                                      ORDER BY recorded_at DESC, data_id DESC) AS rank
            FROM weather_data QUALIFY rank <= 5
            """,
        ),
        "o1_recent_activities": (
            lambda t: topk.newest_with_users(
                t.activities, t.users, "activity_date", "activity_id", 5
            ).select("activity_id", "username", "activity_type", "activity_date"),
            """
            SELECT a.activity_id, u.username, a.activity_type, a.activity_date
            FROM user_activities a JOIN users u ON a.user_id = u.user_id
            ORDER BY a.activity_date DESC NULLS LAST, a.activity_id DESC LIMIT 5
            """,
        ),
        "o2_recent_readings": (
            lambda t: topk.newest(t.weather, "recorded_at", "data_id", 3).select(
                "data_id", "location", "temperature", "humidity", "wind_speed", "recorded_at"
            ),
            """
            SELECT data_id, location, temperature, humidity, wind_speed, recorded_at
            FROM weather_data ORDER BY recorded_at DESC NULLS LAST, data_id DESC LIMIT 3
            """,
        ),
        "o3_time_order_position": (
            lambda t: lookups.history(t.weather, PLACE, 168, AS_OF)
            .orderBy("recorded_at", "data_id")
            .select("data_id", "recorded_at", "temperature"),
            f"""
            SELECT data_id, recorded_at, temperature FROM weather_data
            WHERE location = '{PLACE}'
              AND recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS
            ORDER BY recorded_at, data_id
            """,
        ),
        "o4_alerts_of_user": (
            lambda t: topk.newest(
                lookups.of_user(t.alerts, 42), "created_at", "alert_id"
            ).select("alert_id", "alert_type", "severity", "message", "created_at"),
            """
            SELECT alert_id, alert_type, severity, message, created_at
            FROM weather_alerts WHERE user_id = 42
            ORDER BY created_at DESC NULLS LAST, alert_id DESC
            """,
        ),
        "u1_tracked_locations": (
            lambda t: places.tracked_locations(
                places.default_locations(t.users.sparkSession),
                t.users,
                t.weather.select(
                    F.when(F.col("weather_condition") == "Rainy", "  ")
                    .otherwise(F.concat(F.lit(" "), "location", F.lit("  ")))
                    .alias("location")
                ),
            ),
            """
            SELECT unnest(['London', 'New York', 'Tokyo', 'Paris', 'Sydney']) AS location
            UNION SELECT location FROM users
            UNION SELECT location FROM weather_data WHERE weather_condition <> 'Rainy'
            """,
        ),
    }
)
