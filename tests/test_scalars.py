from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyvane.functions import labels, nested, numbers, text, times


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bands(spark):
    rows = [(9.99,), (10.0,), (20.0,), (29.99,), (30.0,), (None,)]
    got = values(spark, rows, "t DOUBLE", labels.temperature_band(F.col("t")))
    assert got == ["cold", "mild", "warm", "warm", "hot", None]


def test_unknown_condition_is_cloudy(spark):
    rows = [("Snow",), ("Clouds",), ("Fog",), (None,)]
    got = values(spark, rows, "c STRING", labels.condition_category(F.col("c")))
    assert got == ["cold", "cloudy", "cloudy", "cloudy"]


def test_severity_tiers_ignore_case(spark):
    rows = [("high",), ("CRITICAL",), ("Medium",), ("low",), (None,)]
    got = values(spark, rows, "s STRING", labels.severity_tier(F.col("s")))
    assert got == ["danger", "danger", "warning", "info", "info"]


def exact_one_decimal(number: float) -> str:
    """Rounding of the exact binary value, ties away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    shown = str(abs(Decimal(number)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    return f"-{shown}" if number < 0 else shown


def test_one_decimal_rounds_the_binary_value(spark):
    numbers_ = [k / 100 - 5 for k in range(0, 4500, 3)]
    numbers_ += [2.25, -2.25, 0.15, 0.25, 0.35, 9.95, 99.95, -0.04, 0.0, 1013.0, 1e-9, 123456.75]
    got = values(spark, [(n,) for n in numbers_], "n DOUBLE", text.one_decimal(F.col("n")))
    assert got == [exact_one_decimal(n) for n in numbers_]


def test_one_decimal_of_large_and_missing_numbers(spark):
    given = [(None,), (2e15,), (1e12 + 0.25,), (-1e20,), (9.96,)]
    got = values(spark, given, "n DOUBLE", text.one_decimal(F.col("n"), "°C"))
    large = ["2000000000000000.0°C", "1000000000000.3°C", "-100000000000000000000.0°C", "10.0°C"]
    assert got == [None, *large]


def test_weekdays(spark):
    rows = [("2024-01-07 10:00:00",), ("2024-01-08 10:00:00",)]
    moment = F.col("s").cast("timestamp")
    assert values(spark, rows, "s STRING", times.weekday_from_sunday(moment)) == [0, 1]
    assert values(spark, rows, "s STRING", times.weekday_from_monday(moment)) == [6, 0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("31", 31), (" 7 ", 7), ("warm", 15), ("", 15), (None, 15)],
)
def test_int_or_default(spark, given, expected):
    assert values(spark, [(given,)], "s STRING", numbers.int_or(F.col("s"), 15)) == [expected]


def test_clamped_confidence(spark):
    rows = [(-3.0,), (0.7,), (0.99,), (None,)]
    got = values(spark, rows, "x DOUBLE", numbers.clamp_confidence(F.col("x")))
    assert got == [0.6, 0.7, 0.95, None]


PREFERENCES = {
    "null": (None, (None, None, None, False, False)),
    "empty text": ("", (None, None, None, False, False)),
    "empty object": ("{}", (None, None, None, False, False)),
    "malformed": ("{oops", (None, None, None, False, True)),
    "range shape": (
        '{"preferred_activities": ["walking"], "temperature_range": [15, 25], "avoid_rain": true}',
        (["walking"], 15.0, 25.0, True, False),
    ),
    "form shape": (
        '{"preferred_activities": [], "temperature_min": 3, "temperature_max": 9}',
        ([], 3.0, 9.0, False, False),
    ),
}


@pytest.mark.parametrize("case", PREFERENCES)
def test_preference_shapes(spark, case):
    given, expected = PREFERENCES[case]
    (wishes,) = values(spark, [(given,)], "p STRING", nested.preferences(nested.stored_preferences(F.col("p"))))
    got = (
        wishes.preferred_activities,
        wishes.temperature_min,
        wishes.temperature_max,
        wishes.avoid_rain,
        wishes.unreadable is not None,
    )
    assert got == expected


def test_recommendation_bounds_are_inside_the_range(spark):
    rows = [
        (26.0, 15.0, 25.0, ["walking"]),
        (25.0, 15.0, 25.0, ["walking"]),
        (15.0, 15.0, 25.0, []),
        (14.9, 15.0, 25.0, None),
        (14.9, None, None, None),
        (None, 15.0, 25.0, None),
    ]
    advice = labels.recommendation(F.col("t"), F.col("low"), F.col("high"), F.col("a"))
    got = values(spark, rows, "t DOUBLE, low DOUBLE, high DOUBLE, a ARRAY<STRING>", advice)
    assert got == [
        "Stay indoors, temperature is high",
        "Perfect weather for walking",
        "Perfect weather for outdoor activities",
        "Wear warm clothing",
        None,
        None,
    ]
