"""Declared schemas of the four tables and of the JSON text they carry."""

from __future__ import annotations

USERS = (
    "user_id BIGINT, username STRING, email STRING, location STRING, "
    "preferences STRING, created_at TIMESTAMP"
)

WEATHER_DATA = (
    "data_id BIGINT, location STRING, temperature DOUBLE, humidity DOUBLE, pressure DOUBLE, "
    "wind_speed DOUBLE, weather_condition STRING, precipitation DOUBLE, recorded_at TIMESTAMP"
)

USER_ACTIVITIES = (
    "activity_id BIGINT, user_id BIGINT, activity_type STRING, weather_condition STRING, "
    "duration_minutes INT, satisfaction_rating INT, activity_date TIMESTAMP, notes STRING"
)

WEATHER_ALERTS = (
    "alert_id BIGINT, user_id BIGINT, alert_type STRING, severity STRING, message STRING, "
    "trigger_conditions STRING, is_active BOOLEAN, created_at TIMESTAMP"
)

TABLES = {
    "users": USERS,
    "weather_data": WEATHER_DATA,
    "user_activities": USER_ACTIVITIES,
    "weather_alerts": WEATHER_ALERTS,
}

# Both stored shapes of a preference object, side by side.
PREFERENCES = (
    "preferred_activities ARRAY<STRING>, temperature_range ARRAY<DOUBLE>, "
    "temperature_min DOUBLE, temperature_max DOUBLE, avoid_rain BOOLEAN, "
    "avoid_extreme_heat BOOLEAN, avoid_extreme_wind BOOLEAN"
)

TRIGGER_CONDITIONS = "temperature DOUBLE, wind_speed DOUBLE, precipitation DOUBLE"

# Body of one answer of the weather service, and the landed line around it. The body stays
# text, so that a broken answer spoils one field and not the line.
PAYLOAD_BODY = (
    "STRUCT<main: STRUCT<temp: DOUBLE, humidity: DOUBLE, pressure: DOUBLE>, "
    "wind: STRUCT<speed: DOUBLE>, weather: ARRAY<STRUCT<main: STRING>>, "
    "rain: STRUCT<`1h`: DOUBLE>>"
)

LANDED_PAYLOAD = (
    "reading_id BIGINT, location STRING, status INT, received_at TIMESTAMP, body STRING"
)

TRAINING_RUNS = (
    "trained_at TIMESTAMP, locations STRING, data_points BIGINT, train_rows BIGINT, "
    "score DOUBLE, mae DOUBLE, rmse DOUBLE, status STRING"
)
