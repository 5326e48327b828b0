"""The derived tables and check inputs, once as SQL; Spark derives the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.functions.nested import json_object

BASE = """
weather_data AS (
  SELECT event_id AS data_id,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS location,
         CAST(CAST(floor(value * 100) AS BIGINT) % 4500 AS DOUBLE) / CAST(100 AS DOUBLE)
           - CAST(5 AS DOUBLE) AS temperature,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
         CAST(990 + (event_id * 13) % 50 AS DOUBLE) AS pressure,
         CAST((event_id * 11) % 65 AS DOUBLE) AS wind_speed,
         CASE event_type WHEN 'click' THEN 'Sunny' WHEN 'view' THEN 'Cloudy'
              WHEN 'error' THEN 'Rainy' WHEN 'signup' THEN 'Clear' ELSE 'Windy'
         END AS weather_condition,
         CAST((event_id * 5) % 15 AS DOUBLE) AS precipitation,
         ts AS recorded_at
  FROM events
),
users AS (
  SELECT c_custkey AS user_id, c_name AS username,
         lower(replace(c_name, '#', '_')) || '@example.com' AS email,
         n_name AS location,
         CASE WHEN c_custkey % 10 = 1 THEN
                '{"preferred_activities":["walking","cycling","reading"],'
                || '"temperature_range":[15,25],"avoid_rain":true,"avoid_extreme_wind":true}'
              WHEN c_custkey % 10 <> 0 THEN
                '{"preferred_activities":["'
                || CASE c_custkey % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'running' ELSE 'cycling' END
                || '"],"temperature_min":' || CAST(5 + c_custkey % 10 AS VARCHAR)
                || ',"temperature_max":' || CAST(20 + c_custkey % 12 AS VARCHAR)
                || ',"avoid_rain":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END
                || ',"avoid_extreme_heat":true}'
         END AS preferences,
         TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
user_activities AS (
  SELECT o_orderkey AS activity_id, o_custkey AS user_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'cycling'
              WHEN '3-MEDIUM' THEN 'walking' WHEN '5-LOW' THEN 'reading' ELSE 'gardening'
         END AS activity_type,
         CASE o_orderstatus WHEN 'F' THEN 'Sunny' WHEN 'O' THEN 'Cloudy' ELSE 'Rainy'
         END AS weather_condition,
         CAST(10 + o_orderkey % 110 AS INTEGER) AS duration_minutes,
         CAST(1 + o_orderkey % 5 AS INTEGER) AS satisfaction_rating,
         o_orderdate AS activity_date,
         CAST(NULL AS VARCHAR) AS notes
  FROM orders
),
weather_alerts AS (
  SELECT o_orderkey AS alert_id, o_custkey AS user_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'Temperature' WHEN 1 THEN 'Wind' ELSE 'Rain'
         END AS alert_type,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
              WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity,
         'alert ' || CAST(o_orderkey AS VARCHAR) AS message,
         '{"temperature":' || CAST(25 + o_orderkey % 15 AS VARCHAR)
           || '.0,"wind_speed":50.0,"precipitation":10.0}' AS trigger_conditions,
         o_orderstatus <> 'F' AS is_active,
         o_orderdate AS created_at
  FROM orders
)
""".strip()

# One row per location, the newest reading.
LATEST = """
latest AS (
  SELECT * FROM weather_data
  QUALIFY row_number() OVER (PARTITION BY location ORDER BY recorded_at DESC, data_id DESC) = 1
)
"""

# Preferences of both shapes as columns.
WISHES = """
wishes AS (
  SELECT user_id, username, email, location, created_at,
         CAST(json_extract(preferences, '$.preferred_activities') AS VARCHAR[]) AS preferred,
         coalesce(CAST(json_extract_string(preferences, '$.temperature_min') AS DOUBLE),
                  CAST(json_extract_string(preferences, '$.temperature_range[0]') AS DOUBLE))
           AS temperature_min,
         coalesce(CAST(json_extract_string(preferences, '$.temperature_max') AS DOUBLE),
                  CAST(json_extract_string(preferences, '$.temperature_range[1]') AS DOUBLE))
           AS temperature_max,
         coalesce(CAST(json_extract_string(preferences, '$.avoid_rain') AS BOOLEAN), false)
           AS avoid_rain,
         coalesce(CAST(json_extract_string(preferences, '$.avoid_extreme_heat') AS BOOLEAN), false)
           AS avoid_extreme_heat,
         coalesce(CAST(json_extract_string(preferences, '$.avoid_extreme_wind') AS BOOLEAN), false)
           AS avoid_extreme_wind
  FROM users
)
"""

# Active alerts, one row per stored threshold, at the location of their user.
LIMITS = """
limits AS (
  SELECT a.alert_id, a.user_id, u.username, u.location, a.alert_type, a.severity, a.message,
         m.metric,
         CAST(json_extract_string(a.trigger_conditions, '$.' || m.metric) AS DOUBLE) AS threshold
  FROM weather_alerts a
  JOIN users u ON a.user_id = u.user_id
  CROSS JOIN (VALUES ('temperature'), ('wind_speed'), ('precipitation')) m(metric)
  WHERE a.is_active
),
levels AS (
  SELECT data_id, location, recorded_at, 'temperature' AS metric, temperature AS level
  FROM weather_data
  UNION ALL SELECT data_id, location, recorded_at, 'wind_speed', wind_speed FROM weather_data
  UNION ALL SELECT data_id, location, recorded_at, 'precipitation', precipitation FROM weather_data
)
"""

TRIPS = f"""
{LIMITS},
trips AS (
  SELECT l.alert_id, l.user_id, l.username, l.location, l.alert_type, l.severity, l.message,
         l.metric, l.threshold, count(*) AS trips,
         min(r.recorded_at) AS first_tripped_at, max(r.recorded_at) AS last_tripped_at,
         max(r.level) AS peak
  FROM limits l JOIN levels r
    ON l.location = r.location AND l.metric = r.metric AND r.level >= l.threshold
  GROUP BY ALL
)
"""


def landed_payloads(weather: DataFrame) -> DataFrame:
    """Service answers for all readings, with failed, broken and partial ones among them."""
    row = F.col("data_id")
    body = json_object(
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.when(row % 23 != 0, F.struct(F.col("wind_speed").alias("speed"))).alias("wind"),
        F.when(row % 29 != 0, F.array(F.struct(F.col("weather_condition").alias("main"))))
        .otherwise(F.array())
        .alias("weather"),
        F.when(row % 4 == 0, F.struct(F.col("precipitation").alias("1h"))).alias("rain"),
    )
    return weather.select(
        row.alias("reading_id"),
        "location",
        F.when(row % 17 == 0, 500).otherwise(200).alias("status"),
        F.col("recorded_at").alias("received_at"),
        F.when(row % 31 == 0, "<html>bad gateway</html>").otherwise(body).alias("body"),
    )


PARSED = """
parsed AS (
  SELECT data_id, location, CAST(CASE WHEN data_id % 17 = 0 THEN 500 ELSE 200 END AS INTEGER) AS status,
         CASE WHEN data_id % 31 <> 0 THEN temperature END AS temperature,
         CASE WHEN data_id % 31 <> 0 THEN humidity END AS humidity,
         CASE WHEN data_id % 31 <> 0 THEN pressure END AS pressure,
         CASE WHEN data_id % 31 <> 0 AND data_id % 23 <> 0 THEN wind_speed END AS wind_speed,
         CASE WHEN data_id % 31 <> 0 AND data_id % 29 <> 0 THEN weather_condition END
           AS weather_condition,
         CASE WHEN data_id % 31 <> 0 AND data_id % 4 = 0 THEN precipitation END AS precipitation,
         recorded_at
  FROM weather_data
),
usable AS (
  SELECT *, status = 200 AND temperature IS NOT NULL AND humidity IS NOT NULL
            AND pressure IS NOT NULL AND wind_speed IS NOT NULL
            AND weather_condition IS NOT NULL AS ok
  FROM parsed
),
readings AS (
  SELECT data_id, location,
         CASE WHEN ok THEN temperature ELSE 20.0::DOUBLE END AS temperature,
         CASE WHEN ok THEN humidity ELSE 65.0::DOUBLE END AS humidity,
         CASE WHEN ok THEN pressure ELSE 1013.0::DOUBLE END AS pressure,
         CASE WHEN ok THEN wind_speed ELSE 10.0::DOUBLE END AS wind_speed,
         CASE WHEN ok THEN weather_condition ELSE 'Sunny' END AS weather_condition,
         CASE WHEN ok THEN coalesce(precipitation, 0.0::DOUBLE) ELSE 0.0::DOUBLE END
           AS precipitation,
         recorded_at,
         NOT ok AS is_fallback
  FROM usable
)
"""


def sign_ups(tables) -> DataFrame:
    """One sign-up request per activity: many repeat a name, some names are taken, some
    requests share a mailbox, and some lack a field."""
    key = F.col("activity_id")
    number = F.lpad((F.col("user_id") * 3).cast("string"), 9, "0")
    return tables.activities.select(
        key.alias("request_id"),
        F.when(key % 41 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("Customer#"), number))
        .alias("username"),
        F.when(key % 43 != 0, F.concat(F.lit("customer_"), number, F.lit("@example.com"))).alias(
            "email"
        ),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("location"),
    )


SIGN_UPS = """
sign_ups AS (
  SELECT activity_id AS request_id,
         CASE WHEN activity_id % 41 = 0 THEN ' '
              ELSE 'Customer#' || lpad(CAST(user_id * 3 AS VARCHAR), 9, '0') END AS username,
         CASE WHEN activity_id % 43 <> 0
              THEN 'customer_' || lpad(CAST(user_id * 3 AS VARCHAR), 9, '0') || '@example.com'
         END AS email,
         'NATION_' || CAST(user_id % 25 AS VARCHAR) AS location
  FROM user_activities
),
judged AS (
  SELECT s.*,
         CASE WHEN trim(username) = '' THEN 'username is missing'
              WHEN email IS NULL THEN 'email is missing'
              WHEN username IN (SELECT username FROM users) THEN 'username exists'
              WHEN email IN (SELECT email FROM users) THEN 'email exists' END AS first_reason
  FROM sign_ups s
),
decided AS (
  SELECT request_id, username, email, location,
         coalesce(first_reason,
                  CASE WHEN row_number() OVER (PARTITION BY username, first_reason
                                               ORDER BY request_id) > 1
                       THEN 'username repeated' END) AS reason
  FROM judged
)
"""


def preference_requests(tables) -> DataFrame:
    """Submitted preference forms as text, some empty, wrong or out of bounds."""
    key = F.col("user_id")
    return tables.users.select(
        "user_id",
        F.array(F.lit("walking"), F.lit("reading")).alias("preferred_activities"),
        F.when(key % 7 == 0, F.lit(None))
        .when(key % 11 == 0, "warm")
        .otherwise((key % 60 - 15).cast("string"))
        .alias("temperature_min"),
        F.when(key % 5 != 0, ((key * 7) % 60 - 12).cast("string")).alias("temperature_max"),
        F.when(key % 2 == 0, "on").alias("avoid_rain"),
        F.when(key % 3 == 0, "on").alias("avoid_extreme_heat"),
    )


FORMS = """
forms AS (
  SELECT user_id,
         CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 0 THEN 'warm'
              ELSE CAST(user_id % 60 - 15 AS VARCHAR) END AS minimum_text,
         CASE WHEN user_id % 5 <> 0 THEN CAST((user_id * 7) % 60 - 12 AS VARCHAR) END
           AS maximum_text,
         user_id % 2 = 0 AS avoid_rain, user_id % 3 = 0 AS avoid_extreme_heat
  FROM users
),
bounds AS (
  SELECT *, coalesce(TRY_CAST(minimum_text AS INTEGER), 15) AS temperature_min,
         coalesce(TRY_CAST(maximum_text AS INTEGER), 25) AS temperature_max
  FROM forms
)
"""
