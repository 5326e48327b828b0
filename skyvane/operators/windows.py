"""Newest rows per key and next rows in time order, safe for keys that hold many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIME_ORDER = ("recorded_at", "data_id")


def latest_per_location(readings: DataFrame, *columns: str) -> DataFrame:
    """One row per location, the newest; equal times are decided by the id.

    Time and id are packed into one number, so that the aggregate keeps columns of fixed width
    and stays a hash aggregate, one row per location and map task before the shuffle. Naming
    the ``columns`` needed besides time and id keeps the others out of the scan. If all of them
    are of fixed width too, that one pass gives them; else a second one fetches the winning rows
    by a semi join, of a table partitioned by ``recorded_date`` from the days on that hold them.
    Readings without a time are older than all others; a TIMESTAMP_NTZ is read in the session's
    zone.
    """
    if columns:
        readings = readings.select("location", *TIME_ORDER, *columns)
    return newest_by(readings, ("location",))


def newest_by(readings: DataFrame, keys: tuple[str, ...], *counts: Column) -> DataFrame:
    """The newest row of each group of ``keys``, and aggregates of the group, as above."""
    others = [name for name in readings.columns if name not in (*keys, *TIME_ORDER)]
    place = time_and_id()
    whole = not any(_varies(readings, name) for name in others)
    kept = (*TIME_ORDER, *others) if whole else TIME_ORDER
    newest = readings.groupBy(*keys).agg(
        *(F.max_by(name, place).alias(name) for name in kept), *counts
    )
    if whole:
        return newest
    if "recorded_date" in others:
        oldest = newest.agg(F.min(F.to_date("recorded_at"))).scalar()
        day = F.col("recorded_date")
        readings = readings.where((day >= oldest) | day.isNull())
    found = newest.withColumnsRenamed({name: f"_newest_{name}" for name in (*keys, *TIME_ORDER)})
    same = [F.col(name).eqNullSafe(F.col(f"_newest_{name}")) for name in (*keys, *TIME_ORDER)]
    matched = reduce(Column.__and__, same)
    counted = [name for name in found.columns if not name.startswith("_newest_")]
    won = readings.join(found, matched, "inner" if counted else "left_semi")
    # Of a reading that is there twice one is enough; only winners are ranked.
    repeats = Window.partitionBy(*keys).orderBy(*TIME_ORDER)
    first = won.withColumn("_repeat", F.row_number().over(repeats)).where("_repeat = 1")
    return first.select(*readings.columns, *counted)


def time_and_id(time: str = "recorded_at", row_id: str = "data_id") -> Column:
    """A DECIMAL that orders like time, then id; nulls are lowest. It holds years of six digits."""
    micros = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))
    low = F.coalesce(F.col(row_id).cast("bigint"), F.lit(-(1 << 63)))
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return micros.cast("decimal(20,0)") * span + low.cast("decimal(20,0)")


_FIXED_WIDTH = (
    "boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp",
    "timestamp_ntz", "decimal",
)


def _varies(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in _FIXED_WIDTH


def newest_per(df: DataFrame, key: str, time: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each key with their rank.

    The rank filter becomes a group limit that also runs before the shuffle, so a key sends
    at most ``n`` rows per map task.
    """
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(row_id))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_next(
    df: DataFrame,
    key: str,
    values: list[str],
    order: tuple[str, ...] = TIME_ORDER,
    steps: int = 1,
) -> DataFrame:
    """Add ``next``: a struct of ``values`` taken ``steps`` rows later within the key, or null
    where the key has no such row. ``order`` is unique within a key; the key is not null.

    The rows are cut into even pieces by range, so that neither a key nor a single instant has
    to fit one task, whatever placed the rows before. Rows are shifted within each piece, then
    the first and last ``steps`` rows of the pieces among themselves. It is one plan at every
    size, and one lineage, so the pieces, which depend on a sample, are the same for both
    shifts.
    """
    later = F.struct(*values)
    inside = Window.partitionBy(key, "_piece").orderBy(*order)
    across = Window.partitionBy(key, "_group").orderBy(*order)
    is_edge = F.col("_inside").isNull() | (F.col("_position") <= steps)
    return (
        df.repartitionByRange(key, *order)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_inside", F.lead(later, steps).over(inside))
        .withColumn("_position", F.row_number().over(inside))
        .withColumn("_group", F.when(is_edge, F.lit(-1)).otherwise(F.col("_piece")))
        .withColumn("_across", F.lead(later, steps).over(across))
        .withColumn("next", F.coalesce("_inside", "_across"))
        .drop("_piece", "_inside", "_position", "_group", "_across")
    )
