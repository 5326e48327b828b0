"""Text shown next to readings and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CUT = float(1 << 26)


def trimmed(text: Column) -> Column:
    return F.trim(text)


def contains_text(text: Column, part: str) -> Column:
    return text.contains(part)


def one_decimal(number: Column, unit: str = "") -> Column:
    """``21.35`` -> ``21.4`` plus unit; null stays null.

    Rounds the stored binary value, as printing a number does, and an exact tie away from
    zero. ``format_string`` would round the shortest decimal text instead, which turns 0.15,
    stored just below it, into 0.2. The fraction is cut in two so that ten times each part
    is exact.
    """
    size = F.abs(number)
    fraction = size % 1
    upper = F.floor(fraction * _CUT) / _CUT
    lower = fraction - upper
    digit = F.floor(upper * 10)
    rounds_up = lower * 10 >= F.lit(0.5) - (upper * 10 - digit)
    tenths = digit + F.when(rounds_up, 1).otherwise(0)
    whole = size - fraction + F.when(tenths == 10, 1.0).otherwise(0.0)
    return F.concat(
        F.when(number < 0, "-").otherwise(""),
        F.format_string("%.0f", whole),
        F.lit("."),
        (tenths % 10).cast("string"),
        F.lit(unit),
    )


def percent_text(fraction: Column) -> Column:
    return F.when(fraction.isNotNull(), F.format_string("%.0f%%", fraction * 100))


def with_unit(number: Column, unit: str) -> Column:
    return F.concat(number.cast("string"), F.lit(unit))
