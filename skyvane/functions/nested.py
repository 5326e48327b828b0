"""Arrays, dictionaries and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyvane import schemas

CORRUPT = "_corrupt"


def first_or(array: Column, default: str) -> Column:
    """First element; null and empty arrays give the default."""
    return F.coalesce(F.get(array, F.lit(0)), F.lit(default))


def looked_up(entries: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(part) for entry in entries.items() for part in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def json_object(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def parsed_json(text: Column, fields: str) -> Column:
    """JSON object -> struct. Null and empty text read as ``{}``; text that does not parse
    keeps its original in the field ``_corrupt``."""
    filled = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("{}"))
    return F.from_json(
        filled, f"{fields}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}
    )


def stored_preferences(text: Column) -> Column:
    """Preference text as stored: the fields of both shapes."""
    return parsed_json(text, schemas.PREFERENCES)


def preferences(stored: Column) -> Column:
    """Both preference shapes -> one struct; ``stored`` is a column of parsed text, so that
    the text is parsed once and not once per field.

    Bounds come from ``temperature_min``/``temperature_max`` or else from the two elements of
    ``temperature_range``; a missing flag is false; a missing list stays null.
    """
    low, high = (F.get(stored["temperature_range"], F.lit(n)) for n in (0, 1))
    return F.struct(
        stored["preferred_activities"].alias("preferred_activities"),
        F.coalesce(stored["temperature_min"], low).alias("temperature_min"),
        F.coalesce(stored["temperature_max"], high).alias("temperature_max"),
        *(
            F.coalesce(stored[flag], F.lit(False)).alias(flag)
            for flag in ("avoid_rain", "avoid_extreme_heat", "avoid_extreme_wind")
        ),
        stored[CORRUPT].alias("unreadable"),
    )


def trigger_conditions(text: Column) -> Column:
    return parsed_json(text, schemas.TRIGGER_CONDITIONS)
