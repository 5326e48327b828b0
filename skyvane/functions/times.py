"""Parts, text and shifts of timestamps. Weekdays count from Sunday = 0 everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_from_sunday(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def weekday_from_monday(ts: Column) -> Column:
    """Other encoding, for callers that need it; the features use Sunday = 0."""
    return F.weekday(ts)


def month_of(ts: Column) -> Column:
    return F.month(ts)


def plus_hours(ts: Column, hours: Column | int) -> Column:
    amount = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_interval(hours=amount)


def minus_hours(ts: Column, hours: Column | int) -> Column:
    amount = hours if isinstance(hours, Column) else F.lit(hours)
    return ts - F.make_interval(hours=amount)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def day_minute_text(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:mm")


def instant(df: DataFrame, column: str, text: str) -> Column:
    """``text`` as a literal of the type of ``column``, so that comparisons push down."""
    return F.lit(text).cast(df.schema[column].dataType)
