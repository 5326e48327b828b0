"""One registered query per scalar function, over all rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyvane.checks.base_views import FORMS, LATEST, WISHES, preference_requests
from skyvane.checks.registry import register_all
from skyvane.functions import labels, nested, numbers, text, times
from skyvane.operators import recommend, windows
from skyvane.sources import inserts


# Printed from the binary value; printf takes an exact tie to the even digit, so ties, the
# odd quarters, are moved off it.
ONE_DECIMAL = """
printf('%.1f', CASE WHEN abs({0}) * 4 % 2 = 1 THEN {0} + sign({0}) * 0.01 ELSE {0} END) || '°C'
"""


def _readings(columns):
    """A query of new columns next to the id of every reading; ``columns`` makes them, since
    columns cannot be made before there is a session."""
    return lambda t: t.weather.select(
        "data_id", *(value.alias(name) for name, value in columns().items())
    )


def _from_readings(**values: str) -> str:
    columns = ", ".join(f"{value} AS {name}" for name, value in values.items())
    return f"SELECT data_id, {columns} FROM weather_data"


def _category(column: str) -> str:
    return f"""
    CASE WHEN {column} IN ('Clear', 'Sunny') THEN 'sunny'
         WHEN {column} IN ('Rain', 'Rainy') THEN 'rainy'
         WHEN {column} IN ('Thunderstorm', 'Stormy') THEN 'stormy'
         WHEN {column} = 'Snow' THEN 'cold' ELSE 'cloudy' END
    """


def _band(column: str) -> str:
    return f"""
    CASE WHEN {column} < 10 THEN 'cold' WHEN {column} < 20 THEN 'mild'
         WHEN {column} < 30 THEN 'warm' WHEN {column} IS NOT NULL THEN 'hot' END
    """


def _advice(temperature: str) -> str:
    return f"""
    CASE WHEN temperature_min IS NULL OR temperature_max IS NULL OR {temperature} IS NULL THEN NULL
         WHEN {temperature} > temperature_max THEN 'Stay indoors, temperature is high'
         WHEN {temperature} < temperature_min THEN 'Wear warm clothing'
         ELSE 'Perfect weather for ' || coalesce(preferred[1], 'outdoor activities') END
    """


register_all(
    {
        "h_str_1_trim": (
            lambda t: t.users.select(
                "user_id",
                text.trimmed(F.concat(F.lit("  "), "location", F.lit(" "))).alias("location"),
            ),
            "SELECT user_id, location FROM users",
        ),
        "h_str_2_contains": (
            _readings(lambda: dict(is_cloudy=text.contains_text(F.col("weather_condition"), "Cloud"))),
            _from_readings(is_cloudy="contains(weather_condition, 'Cloud')"),
        ),
        "h_str_3_one_decimal": (
            _readings(lambda: dict(shown=text.one_decimal(F.col("temperature"), "°C"))),
            _from_readings(shown=ONE_DECIMAL.format("temperature")),
        ),
        "h_str_4_percent": (
            _readings(lambda: dict(shown=text.percent_text(F.col("humidity") / 100))),
            _from_readings(shown="printf('%.0f', round(humidity / 100 * 100)) || '%'"),
        ),
        "h_str_5_unit": (
            _readings(lambda: dict(
                wind=text.with_unit(F.col("wind_speed").cast("int"), " km/h"),
                pressure=text.with_unit(F.col("pressure").cast("int"), " hPa"),
            )),
            _from_readings(
                wind="CAST(CAST(wind_speed AS INTEGER) AS VARCHAR) || ' km/h'",
                pressure="CAST(CAST(pressure AS INTEGER) AS VARCHAR) || ' hPa'",
            ),
        ),
        "h_dt_1_hour": (
            _readings(lambda: dict(hour=times.hour_of(F.col("recorded_at")))),
            _from_readings(hour="CAST(hour(recorded_at) AS INTEGER)"),
        ),
        "h_dt_2_weekday_sunday": (
            _readings(lambda: dict(weekday=times.weekday_from_sunday(F.col("recorded_at")))),
            _from_readings(weekday="CAST(dayofweek(recorded_at) AS INTEGER)"),
        ),
        "h_dt_3_weekday_monday": (
            _readings(lambda: dict(weekday=times.weekday_from_monday(F.col("recorded_at")))),
            _from_readings(weekday="CAST(isodow(recorded_at) - 1 AS INTEGER)"),
        ),
        "h_dt_4_month": (
            lambda t: t.activities.select(
                "activity_id", times.month_of(F.col("activity_date")).alias("month")
            ),
            "SELECT activity_id, CAST(month(activity_date) AS INTEGER) AS month FROM user_activities",
        ),
        "h_dt_5_shift_hours": (
            _readings(lambda: dict(
                later=times.plus_hours(F.col("recorded_at"), 1), earlier=times.minus_hours(F.col("recorded_at"), 24)
            )),
            _from_readings(
                later="recorded_at + INTERVAL 1 HOUR", earlier="recorded_at - INTERVAL 24 HOURS"
            ),
        ),
        "h_dt_6_iso_text": (
            _readings(lambda: dict(shown=times.iso_text(F.col("recorded_at")))),
            _from_readings(shown="strftime(recorded_at, '%Y-%m-%dT%H:%M:%S')"),
        ),
        "h_dt_7_date_text": (
            lambda t: t.users.select("user_id", times.date_text(F.col("created_at")).alias("shown")),
            "SELECT user_id, strftime(created_at, '%Y-%m-%d') AS shown FROM users",
        ),
        "h_dt_8_minute_texts": (
            _readings(lambda: dict(
                minute=times.minute_text(F.col("recorded_at")),
                clock=times.clock_text(F.col("recorded_at")),
                day_minute=times.day_minute_text(F.col("recorded_at")),
            )),
            _from_readings(
                minute="strftime(recorded_at, '%Y-%m-%d %H:%M')",
                clock="strftime(recorded_at, '%H:%M')",
                day_minute="strftime(recorded_at, '%m-%d %H:%M')",
            ),
        ),
        "h_ma_1_scaled_pressure": (
            _readings(lambda: dict(scaled=numbers.hectopascal_scaled(F.col("pressure")))),
            _from_readings(scaled="pressure / 100"),
        ),
        "h_ma_2_round_half_even": (
            _readings(lambda: dict(
                one=numbers.round_half_even(F.col("pressure") / 4, 1),
                three=numbers.round_half_even(F.col("humidity") / 16, 3),
            )),
            _from_readings(
                one="round_even(pressure / 4, 1)", three="round_even(humidity / 16, 3)"
            ),
        ),
        "h_ma_3_clamp": (
            _readings(lambda: dict(confidence=numbers.clamp_confidence(F.col("humidity") / 100))),
            _from_readings(confidence="least(0.95::DOUBLE, greatest(0.6::DOUBLE, humidity / 100))"),
        ),
        "h_ma_4_number_or_default": (
            lambda t: preference_requests(t).select(
                "user_id",
                numbers.int_or(F.col("temperature_min"), 15).alias("minimum"),
                numbers.double_or(F.col("temperature_max"), 25).alias("maximum"),
            ),
            f"""
            , {FORMS} SELECT user_id, temperature_min AS minimum,
                             CAST(temperature_max AS DOUBLE) AS maximum FROM bounds
            """,
        ),
        "h_arr_1_first_or_default": (
            lambda t: recommend.with_preferences(t.users).select(
                "user_id",
                nested.first_or(
                    F.col("wishes.preferred_activities"), labels.DEFAULT_ACTIVITY
                ).alias("activity"),
            ),
            f"""
            , {WISHES}
            SELECT user_id, coalesce(preferred[1], 'outdoor activities') AS activity FROM wishes
            """,
        ),
        "h_arr_2_values_to_array": (
            lambda t: t.activities.groupBy("user_id").agg(
                F.array_join(F.array_sort(F.collect_set("activity_type")), ",").alias("activities")
            ),
            """
            SELECT user_id, string_agg(DISTINCT activity_type, ',' ORDER BY activity_type)
                   AS activities
            FROM user_activities GROUP BY user_id
            """,
        ),
        "h_arr_3_activity_popularity": (
            lambda t: recommend.wished_activity_counts(t.users),
            f"""
            , {WISHES}
            SELECT activity, count(*) AS n_users
            FROM (SELECT unnest(preferred) AS activity FROM wishes) GROUP BY activity
            """,
        ),
        "h_map_1_lookup": (
            _readings(lambda: dict(
                category=nested.looked_up(
                    labels.CONDITION_CATEGORIES, F.col("weather_condition"), "cloudy"
                )
            )),
            _from_readings(category=_category("weather_condition")),
        ),
        "h_map_2_optional_field": (
            lambda t: preference_requests(t).select(
                "user_id", F.coalesce("temperature_max", F.lit("25")).alias("maximum_text")
            ),
            f", {FORMS} SELECT user_id, coalesce(maximum_text, '25') AS maximum_text FROM forms",
        ),
        "h_json_1_object_to_text": (
            lambda t: inserts.preference_forms(preference_requests(t)).select(
                "user_id", "preferences"
            ),
            f"""
            , {FORMS}
            SELECT user_id,
                   '{{"preferred_activities":["walking","reading"],"temperature_min":'
                   || CAST(temperature_min AS VARCHAR) || ',"temperature_max":'
                   || CAST(temperature_max AS VARCHAR) || ',"avoid_rain":'
                   || CASE WHEN avoid_rain THEN 'true' ELSE 'false' END
                   || ',"avoid_extreme_heat":'
                   || CASE WHEN avoid_extreme_heat THEN 'true' ELSE 'false' END
                   || '}}' AS preferences
            FROM bounds
            """,
        ),
        "h_json_2_text_to_object": (
            lambda t: t.alerts.select(
                "alert_id",
                nested.trigger_conditions(
                    F.when(F.col("severity") == "Low", "{broken")
                    .when(F.col("severity") == "Medium", "")
                    .otherwise(F.col("trigger_conditions"))
                ).alias("parsed"),
            ).select(
                "alert_id",
                F.col("parsed.temperature").alias("temperature"),
                F.col("parsed._corrupt").isNotNull().alias("is_corrupt"),
            ),
            """
            SELECT alert_id,
                   CASE WHEN severity IN ('High', 'Critical') THEN CAST(
                     json_extract_string(trigger_conditions, '$.temperature') AS DOUBLE) END
                     AS temperature,
                   severity = 'Low' AS is_corrupt
            FROM weather_alerts
            """,
        ),
        "h_json_3_normalised_preferences": (
            lambda t: recommend.with_preferences(t.users).select(
                "user_id",
                F.array_join("wishes.preferred_activities", ",").alias("activities"),
                "wishes.temperature_min",
                "wishes.temperature_max",
                "wishes.avoid_rain",
                "wishes.avoid_extreme_heat",
                "wishes.avoid_extreme_wind",
            ),
            f"""
            , {WISHES}
            SELECT user_id, array_to_string(preferred, ',') AS activities, temperature_min,
                   temperature_max, avoid_rain, avoid_extreme_heat, avoid_extreme_wind
            FROM wishes
            """,
        ),
        "h_json_4_nested_path": (
            lambda t: t.alerts.select(
                "alert_id",
                F.get_json_object("trigger_conditions", "$.wind_speed")
                .cast("double")
                .alias("wind_limit"),
            ),
            """
            SELECT alert_id, CAST(json_extract_string(trigger_conditions, '$.wind_speed')
                                  AS DOUBLE) AS wind_limit
            FROM weather_alerts
            """,
        ),
        "h_cond_1_band": (
            _readings(lambda: dict(band=labels.temperature_band(F.col("temperature")))),
            _from_readings(band=_band("temperature")),
        ),
        "h_cond_2_category": (
            _readings(lambda: dict(category=labels.condition_category(F.col("weather_condition")))),
            _from_readings(category=_category("weather_condition")),
        ),
        "h_cond_3_severity_tier": (
            lambda t: t.alerts.select(
                "alert_id", labels.severity_tier(F.lower("severity")).alias("tier")
            ),
            """
            SELECT alert_id, CASE WHEN severity IN ('High', 'Critical') THEN 'danger'
                                  WHEN severity = 'Medium' THEN 'warning' ELSE 'info' END AS tier
            FROM weather_alerts
            """,
        ),
        "h_cond_4_recommendation": (
            lambda t: recommend.recommendations(
                t.users, windows.latest_per_location(t.weather, "temperature")
            ).select("user_id", "recommendation"),
            f"""
            , {LATEST}, {WISHES}
            SELECT w.user_id, {_advice("l.temperature")} AS recommendation
            FROM wishes w LEFT JOIN latest l ON w.location = l.location
            """,
        ),
        "h_cond_5_null_to_zero": (
            lambda t: t.users.join(
                t.activities.where(F.col("satisfaction_rating") == 5)
                .groupBy("user_id")
                .agg(F.count("*").alias("n")),
                "user_id",
                "left",
            ).select("user_id", numbers.or_zero(F.col("n")).alias("best_rated")),
            """
            SELECT u.user_id, coalesce(c.n, 0) AS best_rated
            FROM users u LEFT JOIN (
              SELECT user_id, count(*) AS n FROM user_activities
              WHERE satisfaction_rating = 5 GROUP BY user_id
            ) c ON u.user_id = c.user_id
            """,
        ),
    }
)
