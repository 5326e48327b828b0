"""User-facing queries."""

from __future__ import annotations

from skyvane.checks.base_views import LATEST, TRIPS, WISHES
from skyvane.checks.registry import AS_OF, PLACE, register_all
from skyvane.checks.scalars import ONE_DECIMAL, _advice, _band, _category
from skyvane.operators import forecast
from skyvane.plans import alerts, dashboard, profiles, training

TIER = """
CASE WHEN {0} IN ('High', 'Critical') THEN 'danger' WHEN {0} = 'Medium' THEN 'warning'
     ELSE 'info' END
"""

PAIRS = """
pairs AS (
  SELECT data_id, location, recorded_at, temperature, humidity,
         pressure / 100 AS pressure_scaled, wind_speed,
         CAST(hour(recorded_at) AS INTEGER) AS hour,
         CAST(dayofweek(recorded_at) AS INTEGER) AS day_of_week,
         CAST(month(recorded_at) AS INTEGER) AS month,
         lead(temperature) OVER (PARTITION BY location ORDER BY recorded_at, data_id) AS target
  FROM history
)
"""

register_all(
    {
        "q2_recent_activities": (
            lambda t: dashboard.recent_activities(t),
            """
            SELECT activity_id, username, activity_type, weather_condition,
                   strftime(activity_date, '%Y-%m-%d %H:%M') AS activity_minute
            FROM user_activities a JOIN users u ON a.user_id = u.user_id
            ORDER BY activity_date DESC NULLS LAST, activity_id DESC LIMIT 5
            """,
        ),
        "q3_recent_readings": (
            lambda t: dashboard.recent_readings(t),
            f"""
            SELECT data_id, location, {ONE_DECIMAL.format("temperature")} AS temperature_text,
                   {_band("temperature")} AS band, weather_condition,
                   {_category("weather_condition")} AS category, humidity, wind_speed,
                   strftime(recorded_at, '%Y-%m-%d %H:%M') AS recorded_minute
            FROM weather_data ORDER BY recorded_at DESC NULLS LAST, data_id DESC LIMIT 3
            """,
        ),
        "q4_user_list": (
            lambda t: dashboard.user_list(t),
            """
            , done AS (SELECT user_id, count(*) AS n FROM user_activities GROUP BY 1),
            armed AS (SELECT user_id, count(*) AS n FROM weather_alerts WHERE is_active GROUP BY 1)
            SELECT user_id, username, email, location,
                   coalesce(done.n, 0) AS activity_count, coalesce(armed.n, 0) AS alert_count,
                   strftime(created_at, '%Y-%m-%d') AS member_since
            FROM users LEFT JOIN done USING (user_id) LEFT JOIN armed USING (user_id)
            """,
        ),
        "q5_user_profiles": (
            lambda t: profiles.profiles(t),
            f"""
            , {WISHES},
            counted AS (
              SELECT user_id, count(*) AS n, count(*) FILTER (WHERE is_active) AS n_active
              FROM weather_alerts GROUP BY user_id
            ),
            newest_activities AS (
              SELECT * FROM user_activities QUALIFY row_number() OVER (
                PARTITION BY user_id ORDER BY activity_date DESC, activity_id DESC) <= 10
            ),
            newest_readings AS (
              SELECT * FROM weather_data QUALIFY row_number() OVER (
                PARTITION BY location ORDER BY recorded_at DESC, data_id DESC) <= 5
            )
            SELECT w.user_id, 'header' AS section, w.user_id AS item_id,
                   strftime(created_at, '%Y-%m-%d') AS at, username AS title,
                   concat_ws('; ', location, email,
                     'alerts ' || CAST(coalesce(n, 0) AS VARCHAR),
                     'active ' || CAST(coalesce(n_active, 0) AS VARCHAR),
                     {ONE_DECIMAL.format("temperature_min")} || ' - '
                       || {ONE_DECIMAL.format("temperature_max")},
                     array_to_string(preferred, ','),
                     CASE WHEN avoid_rain THEN 'Avoid Rain' END,
                     CASE WHEN avoid_extreme_heat THEN 'Avoid Extreme Heat' END,
                     CASE WHEN avoid_extreme_wind THEN 'Avoid Extreme Wind' END) AS detail
            FROM wishes w LEFT JOIN counted c ON w.user_id = c.user_id
            UNION ALL
            SELECT user_id, 'activity', activity_id, strftime(activity_date, '%m-%d %H:%M'),
                   activity_type,
                   concat_ws('; ', weather_condition,
                             CAST(duration_minutes AS VARCHAR) || 'min',
                             CAST(satisfaction_rating AS VARCHAR) || ' stars')
            FROM newest_activities WHERE user_id IN (SELECT user_id FROM users)
            UNION ALL
            SELECT user_id, 'alert', alert_id, strftime(created_at, '%Y-%m-%d'), alert_type,
                   concat_ws('; ', {TIER.format("severity")}, message)
            FROM weather_alerts WHERE user_id IN (SELECT user_id FROM users)
            UNION ALL
            SELECT u.user_id, 'reading', r.data_id, strftime(r.recorded_at, '%H:%M'),
                   r.weather_condition,
                   concat_ws('; ', {ONE_DECIMAL.format("r.temperature")},
                             {_band("r.temperature")},
                             CAST(CAST(r.humidity AS INTEGER) AS VARCHAR) || '%',
                             CAST(CAST(r.wind_speed AS INTEGER) AS VARCHAR) || ' km/h',
                             CAST(CAST(r.pressure AS INTEGER) AS VARCHAR) || ' hPa')
            FROM users u JOIN newest_readings r ON u.location = r.location
            """,
        ),
        "q6_recommendations": (
            lambda t: profiles.recommendations(t),
            f"""
            , {LATEST}, {WISHES}
            SELECT w.user_id, w.username, w.location, l.temperature, w.temperature_min,
                   w.temperature_max, {_advice("l.temperature")} AS recommendation
            FROM wishes w LEFT JOIN latest l ON w.location = l.location
            """,
        ),
        "q7_tripped_alerts": (
            lambda t: alerts.tripped_alerts(t),
            f"""
            , {LATEST}, {TRIPS}
            SELECT l.alert_id, l.user_id, l.username, l.location, l.alert_type,
                   {TIER.format("l.severity")} AS tier, l.message, l.metric, r.level AS value,
                   l.threshold, strftime(r.recorded_at, '%Y-%m-%d %H:%M') AS recorded_minute
            FROM limits l
            JOIN levels r ON l.location = r.location AND l.metric = r.metric
                         AND r.level >= l.threshold
            WHERE r.data_id IN (SELECT data_id FROM latest)
            """,
        ),
        "q8_fixed_warnings": (
            lambda t: alerts.warnings(t),
            """
            SELECT data_id, location, temperature, wind_speed, recorded_at,
                   'Heat Warning' AS title, 'Extreme temperature detected!' AS message,
                   'warning' AS level
            FROM weather_data WHERE temperature > 35
            UNION ALL
            SELECT data_id, location, temperature, wind_speed, recorded_at,
                   'Wind Warning', 'High wind conditions!', 'danger'
            FROM weather_data WHERE wind_speed > 50
            """,
        ),
        "q9_training_features": (
            lambda t: training.training_data(t, PLACE, AS_OF, 168),
            f"""
            , recent AS (
              SELECT * FROM weather_data
              WHERE location = '{PLACE}'
                AND recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS
            ),
            history AS (SELECT * FROM recent WHERE (SELECT count(*) FROM recent) >= 20),
            {PAIRS}
            SELECT * FROM pairs WHERE target IS NOT NULL
            """,
        ),
        "m1_features_and_targets": (
            lambda t: forecast.training_pairs(t.weather),
            f"""
            , history AS (SELECT * FROM weather_data), {PAIRS}
            SELECT * FROM pairs WHERE target IS NOT NULL
            """,
        ),
    }
)
