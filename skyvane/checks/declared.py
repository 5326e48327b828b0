"""Capabilities that are only declared: no working code stands behind them elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.checks.base_views import LATEST, WISHES
from skyvane.checks.composites import PAIRS
from skyvane.checks.registry import AS_OF, register, register_all
from skyvane.functions import times
from skyvane.operators import aggregates, forecast, lookups, recommend, trends, windows
from skyvane.operators.rules import METRICS
from skyvane.plans import alerts, dashboard
from skyvane.session import shared_folder
from skyvane.sources import sinks
from skyvane.sources.tables import driver_tables

ALERTS_AS_OF = "2000-01-01 00:00:00"


def _conditions(tables) -> DataFrame:
    """Free-text conditions, one per activity of a user at the user's location."""
    minutes = F.col("duration_minutes")
    return tables.activities.join(tables.users.select("user_id", "location"), "user_id").select(
        "activity_id",
        "location",
        F.when(minutes % 4 == 0, F.concat(F.lit("temperature > "), (minutes % 40).cast("string"), F.lit("°C")))
        .when(minutes % 4 == 1, F.concat(F.lit("wind_speed >= "), (minutes % 60).cast("string")))
        .when(minutes % 4 == 2, F.concat(F.lit("precipitation<"), (minutes % 15).cast("string"), F.lit(".5")))
        .otherwise("when it feels cold")
        .alias("condition"),
    )


def _announcements(tables) -> DataFrame:
    """One announcement per alert rule: critical ones to all, others to one location."""
    return tables.alerts.select(
        "alert_id",
        F.when(F.col("severity") == "Critical", "all")
        .otherwise(F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")))
        .alias("audience"),
    )


def _expiring(tables) -> DataFrame:
    hours = (
        F.when(F.col("severity") == "Low", 1)
        .when(F.col("severity") == "Medium", 6)
        .when(F.col("severity") == "High", 24)
        .otherwise(168)
    )
    return tables.alerts.select("alert_id", "created_at", hours.alias("expiry_hours"))


def _exported(file_format: str, schema: str):
    def run(spark, folder: str) -> DataFrame:
        target = shared_folder(spark, f"export-{file_format}")
        sinks.export(dashboard.user_list(driver_tables(spark, folder)), target, file_format)
        return spark.read.schema(schema).option("header", True).format(file_format).load(target)

    return run


USER_LIST = (
    "user_id BIGINT, username STRING, email STRING, location STRING, activity_count BIGINT, "
    "alert_count BIGINT, member_since STRING"
)
USER_LIST_SQL = """
SELECT u.user_id, u.username, u.email, u.location,
       (SELECT count(*) FROM user_activities ua WHERE ua.user_id = u.user_id) AS activity_count,
       (SELECT count(*) FROM weather_alerts wa WHERE wa.user_id = u.user_id AND wa.is_active)
         AS alert_count,
       strftime(u.created_at, '%Y-%m-%d') AS member_since
FROM users u
"""
for _format in ("csv", "json"):
    register(f"d10_export_{_format}", _exported(_format, USER_LIST), USER_LIST_SQL)


def _trend(unit: str):
    return lambda t: trends.trend(t.weather, unit).select(
        "location",
        F.col("period").cast("timestamp_ntz").alias("period"),
        F.round("mean", 6).alias("mean"),
        "low",
        "high",
        "n",
        F.round("change", 6).alias("change"),
    )


def _trend_sql(unit: str) -> str:
    return f"""
    , periods AS (
      SELECT location, CAST(date_trunc('{unit}', recorded_at) AS TIMESTAMP) AS period,
             avg(temperature) AS mean, min(temperature) AS low, max(temperature) AS high,
             count(*) AS n
      FROM weather_data GROUP BY ALL
    )
    SELECT location, period, round(mean, 6) AS mean, low, high, n,
           round(mean - lag(mean) OVER (PARTITION BY location ORDER BY period), 6) AS change
    FROM periods
    """


def _targets_ahead(steps: int, target: str):
    return lambda t: forecast.training_pairs(t.weather, steps=steps, target=target).select(
        "data_id", "location", "temperature", "hour", "target"
    )


def _targets_ahead_sql(steps: int, target: str) -> str:
    return f"""
    , ahead AS (
      SELECT data_id, location, temperature, CAST(hour(recorded_at) AS INTEGER) AS hour,
             lead({target}, {steps}) OVER (PARTITION BY location ORDER BY recorded_at, data_id)
               AS target
      FROM weather_data
    )
    SELECT * FROM ahead WHERE target IS NOT NULL
    """


register_all(
    {
        "d1_alert_counts_by_severity": (
            lambda t: trends.severity_counts(t.alerts),
            """
            SELECT count(*) FILTER (WHERE is_active AND severity IN ('High', 'Critical')) AS high,
                   count(*) FILTER (WHERE is_active AND severity = 'Medium') AS medium,
                   count(*) FILTER (WHERE is_active AND severity = 'Low') AS low,
                   count(*) FILTER (WHERE NOT is_active) AS resolved
            FROM weather_alerts
            """,
        ),
        "d2_alert_history": (
            lambda t: alerts.alert_history(t),
            """
            SELECT alert_id, strftime(a.created_at, '%Y-%m-%d %H:%M') AS time, username,
                   alert_type, severity, message,
                   CASE WHEN is_active THEN 'active' ELSE 'resolved' END AS status
            FROM weather_alerts a JOIN users u ON a.user_id = u.user_id
            """,
        ),
        "d3_alert_audience": (
            lambda t: trends.audience_sizes(_announcements(t), t.users),
            """
            , announcements AS (
              SELECT alert_id, CASE WHEN severity = 'Critical' THEN 'all'
                     ELSE 'NATION_' || CAST(user_id % 30 AS VARCHAR) END AS audience
              FROM weather_alerts
            )
            SELECT alert_id, audience,
                   CASE WHEN audience = 'all' THEN (SELECT count(*) FROM users)
                        ELSE coalesce(n, 0) END AS n_users
            FROM announcements LEFT JOIN (
              SELECT location, count(*) AS n FROM users GROUP BY location
            ) ON audience = location
            """,
        ),
        "d4_unexpired_alerts": (
            lambda t: trends.unexpired(
                _expiring(t), times.instant(t.alerts, "created_at", ALERTS_AS_OF)
            ),
            f"""
            , expiring AS (
              SELECT alert_id, created_at,
                     CAST(CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 6
                                        WHEN 'High' THEN 24 ELSE 168 END AS INTEGER)
                       AS expiry_hours
              FROM weather_alerts
            )
            SELECT * FROM expiring
            WHERE created_at <= TIMESTAMP '{ALERTS_AS_OF}'
              AND created_at + to_hours(expiry_hours) > TIMESTAMP '{ALERTS_AS_OF}'
            """,
        ),
        "d5_alerts_without_metric": (
            lambda t: lookups.of_type(
                t.alerts.withColumn(
                    "alert_type",
                    F.when(F.col("severity") == "Critical", "storm")
                    .when(F.col("severity") == "High", "uv")
                    .otherwise(F.col("alert_type")),
                ),
                "Storm",
                "Uv",
            ).select("alert_id", "severity"),
            """
            SELECT alert_id, severity FROM weather_alerts WHERE severity IN ('Critical', 'High')
            """,
        ),
        "d6_free_text_conditions": (
            lambda t: trends.met_conditions(
                _conditions(t), windows.latest_per_location(t.weather, *METRICS)
            ),
            f"""
            , {LATEST}, conditions AS (
              SELECT a.activity_id, u.location, duration_minutes AS m,
                     CASE duration_minutes % 4
                       WHEN 0 THEN 'temperature > ' || CAST(duration_minutes % 40 AS VARCHAR) || '°C'
                       WHEN 1 THEN 'wind_speed >= ' || CAST(duration_minutes % 60 AS VARCHAR)
                       WHEN 2 THEN 'precipitation<' || CAST(duration_minutes % 15 AS VARCHAR) || '.5'
                       ELSE 'when it feels cold' END AS condition
              FROM user_activities a JOIN users u ON a.user_id = u.user_id
            )
            SELECT c.activity_id, c.location, c.condition, l.data_id,
                   CASE m % 4 WHEN 0 THEN temperature WHEN 1 THEN wind_speed
                              ELSE precipitation END AS value
            FROM conditions c JOIN latest l ON c.location = l.location
            WHERE CASE m % 4 WHEN 0 THEN temperature > m % 40 WHEN 1 THEN wind_speed >= m % 60
                             WHEN 2 THEN precipitation < m % 15 + 0.5 ELSE false END
            """,
        ),
        "d7_error_measures": (
            lambda t: aggregates.regression_metrics(
                forecast.persistence(forecast.training_pairs(t.weather)), "target", "prediction"
            ).select(
                "n",
                F.round("r2", 6).alias("r2"),
                F.round("mae", 6).alias("mae"),
                F.round("rmse", 6).alias("rmse"),
            ),
            f"""
            , history AS (SELECT * FROM weather_data), {PAIRS}
            SELECT count(*) AS n,
                   round(1 - avg((target - temperature) ** 2) / var_pop(target), 6) AS r2,
                   round(avg(abs(target - temperature)), 6) AS mae,
                   round(sqrt(avg((target - temperature) ** 2)), 6) AS rmse
            FROM pairs WHERE target IS NOT NULL
            """,
        ),
        "d8_hourly_trend": (_trend("hour"), _trend_sql("hour")),
        "d8_daily_trend": (_trend("day"), _trend_sql("day")),
        "d9_location_comparison": (
            lambda t: trends.comparison(t.weather).select(
                F.col("period").cast("timestamp_ntz").alias("period"),
                "location",
                F.round("mean", 6).alias("mean"),
            ),
            """
            SELECT CAST(date_trunc('day', recorded_at) AS TIMESTAMP) AS period, location,
                   round(avg(temperature), 6) AS mean
            FROM weather_data GROUP BY 1, 2
            """,
        ),
        "d11_targets_24_ahead": (
            _targets_ahead(24, "temperature"),
            _targets_ahead_sql(24, "temperature"),
        ),
        "d11_targets_48_ahead": (
            _targets_ahead(48, "temperature"),
            _targets_ahead_sql(48, "temperature"),
        ),
        "d12_extreme_readings": (
            lambda t: trends.extremes(t.weather, 1.5).withColumn("score", F.round("score", 6)),
            """
            , usual AS (
              SELECT location, CAST(recorded_at AS DATE) AS day, avg(temperature) AS usual,
                     stddev_pop(temperature) AS spread
              FROM weather_data GROUP BY ALL
            )
            SELECT w.data_id, w.location, w.recorded_at, w.temperature,
                   round((w.temperature - u.usual) / u.spread, 6) AS score
            FROM weather_data w
            JOIN usual u ON w.location = u.location AND CAST(w.recorded_at AS DATE) = u.day
            WHERE u.spread > 0 AND abs((w.temperature - u.usual) / u.spread) >= 1.5
            """,
        ),
        "d13_avoidances": (
            lambda t: recommend.avoidances(
                t.users,
                windows.latest_per_location(
                    t.weather, "temperature", "wind_speed", "weather_condition"
                ),
            ),
            f"""
            , {LATEST}, {WISHES}
            SELECT w.user_id, w.location,
                   coalesce(avoid_rain AND weather_condition IN
                            ('Rain', 'Rainy', 'Thunderstorm', 'Stormy'), false) AS rain_to_avoid,
                   coalesce(avoid_extreme_heat AND temperature > 35, false) AS heat_to_avoid,
                   coalesce(avoid_extreme_wind AND wind_speed > 50, false) AS wind_to_avoid
            FROM wishes w LEFT JOIN latest l ON w.location = l.location
            """,
        ),
        "d13_activity_suitability": (
            lambda t: recommend.activity_suitability(t.activities).select(
                "activity_type",
                "weather_condition",
                "n",
                F.round("mean_rating", 6).alias("mean_rating"),
                F.round("mean_minutes", 6).alias("mean_minutes"),
            ),
            """
            SELECT activity_type, weather_condition, count(*) AS n,
                   round(avg(satisfaction_rating), 6) AS mean_rating,
                   round(avg(duration_minutes), 6) AS mean_minutes
            FROM user_activities GROUP BY ALL
            """,
        ),
        "d16_precipitation_targets": (
            _targets_ahead(1, "precipitation"),
            _targets_ahead_sql(1, "precipitation"),
        ),
    }
)
