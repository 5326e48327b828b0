"""Streams of readings: repeats dropped, ticks, enrichment, scoring and storage."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyvane import schemas
from skyvane.operators import forecast, joins, rules
from skyvane.operators.windows import newest_by
from skyvane.session import checkpointed, settled
from skyvane.sources import sinks
from skyvane.sources.committed import CommittedTable, LatestReadings, Versions

LATE_BY = "10 minutes"
TICK = "2 minutes"


def timed(readings: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks require, with the late-data bound."""
    return readings.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark(
        "recorded_at", LATE_BY
    )


def without_repeats(readings: DataFrame) -> DataFrame:
    """First arrival per location and time; its state is dropped behind the watermark, and so
    is a first arrival that late. ``first_arrivals`` keeps those."""
    return timed(readings).dropDuplicatesWithinWatermark(["location", "recorded_at"])


def with_tick(readings: DataFrame) -> DataFrame:
    """The two-minute tick of each reading."""
    tick = F.window(F.col("recorded_at").cast("timestamp"), TICK)
    return readings.withColumns({"tick_start": tick["start"], "tick_end": tick["end"]})


def latest_per_tick(readings: DataFrame) -> DataFrame:
    """Newest reading per location and two-minute tick, and how many it has."""
    ticked = with_tick(readings).where("tick_start IS NOT NULL")
    newest = newest_by(ticked, ("tick_start", "tick_end", "location"), F.count("*").alias("n"))
    return newest.select("tick_start", "tick_end", "location", "n", *_others(readings))


def _others(readings: DataFrame) -> list[str]:
    return [name for name in readings.columns if name != "location"]


# State and output of ``closed_ticks`` and ``first_arrivals`` over stored readings.
TICKS = f"tick_start TIMESTAMP, tick_end TIMESTAMP, n BIGINT, {schemas.WEATHER_DATA}"
ARRIVALS = "location STRING, recorded_at TIMESTAMP"


def closed_ticks(
    stream: DataFrame,
    table: CommittedTable,
    late: CommittedTable,
    held: Versions,
    state: str,
    every: str | None = None,
) -> StreamingQuery:
    """The newest reading of each tick and location, once the tick is closed: when a reading
    ten minutes behind its end was seen. ``held`` keeps the winners of open ticks, one row each.
    Readings of a tick that was closed when their batch began, and those without a time, go to
    ``late``; none is lost. Each table commits a batch once, and ``held``, on which a batch
    depends, is the last to do so.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(batch.sparkSession, state, batch_id)

        def made(open_ticks: DataFrame, seen: str | None) -> tuple[DataFrame, str | None]:
            own = with_tick(batch.select(*_names(schemas.WEATHER_DATA)))
            is_late = F.coalesce(F.col("tick_end") <= _behind(seen), F.col("tick_end").isNull())
            late.append(own.where(is_late).drop("tick_start", "tick_end"), key)
            now = _newest_seen(batch, seen)
            arrived = own.where(~is_late).withColumn("n", F.lit(1).cast("long"))
            merged = checkpointed(
                newest_by(
                    open_ticks.unionByName(arrived).withColumnRenamed("n", "_n"),
                    ("tick_start", "tick_end", "location"),
                    F.sum("_n").alias("n"),
                ).select(*open_ticks.columns)
            )
            is_closed = F.coalesce(F.col("tick_end") <= _behind(now), F.lit(False))
            table.append(merged.where(is_closed), key)
            return merged.where(~is_closed), now

        held.replace(made, key)

    return start_per_batch(stream, update, state, every)


def first_arrivals(
    stream: DataFrame,
    table: CommittedTable,
    late: CommittedTable,
    held: Versions,
    state: str,
    every: str | None = None,
) -> StreamingQuery:
    """The first arrival per location and time. ``held`` keeps what arrived within the last ten
    minutes of event time, by which repeats are known. A reading that is later than that goes to
    ``late`` unless it is in either table already, so that both together hold every location
    and time once. Readings without a time repeat no other one.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(batch.sparkSession, state, batch_id)

        def made(known: DataFrame, seen: str | None) -> tuple[DataFrame, str | None]:
            own = batch.select("location", F.col("recorded_at").cast("timestamp").alias("recorded_at"))
            untimed = own.where("recorded_at IS NULL")
            own = checkpointed(own.where("recorded_at IS NOT NULL").distinct())
            is_late = F.coalesce(F.col("recorded_at") <= _behind(seen), F.lit(False))
            # The tables as they were before this batch, should it run again.
            if not late.commits.has(key):
                behind = own.where(is_late)
                oldest = behind.agg(F.min("recorded_at")).scalar()
                there = table.rows().unionByName(late.rows()).where(F.col("recorded_at") >= oldest)
                late.append(_not_in(behind, there), key)
            now = _newest_seen(batch, seen)
            fresh = _not_in(own.where(~is_late), known)
            table.append(fresh.unionByName(untimed), key)
            still = F.coalesce(F.col("recorded_at") > _behind(now), F.lit(True))
            return known.unionByName(fresh).where(still), now

        held.replace(made, key)

    return start_per_batch(stream, update, state, every)


def _not_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    same = rows["location"].eqNullSafe(known["location"]) & (
        rows["recorded_at"] == known["recorded_at"]
    )
    return rows.join(known, same, "left_anti")


def _names(columns: str) -> list[str]:
    return [column.split()[0] for column in columns.split(", ")]


def _newest_seen(batch: DataFrame, seen: str | None) -> str | None:
    """The newest event time of this batch and those before it, as text of microseconds."""
    newest = batch.agg(F.max(F.unix_micros(F.col("recorded_at").cast("timestamp")))).first()[0]
    known = [int(value) for value in (newest, seen) if value is not None]
    return str(max(known)) if known else None


def _behind(seen: str | None) -> Column:
    """The time up to which event times are late; null before there is any."""
    newest = F.lit(None if seen is None else int(seen)).cast("long")
    return F.timestamp_micros(newest) - F.expr(f"INTERVAL {LATE_BY}")


def start_to_folder(
    stream: DataFrame,
    folder: str,
    state: str,
    file_format: str = "parquet",
    partition_by: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append a stream to files exactly once. ``every`` keeps it running at that pace;
    without it the stream takes what is there and ends."""
    writer = (
        stream.writeStream.format(file_format)
        .option("path", folder)
        .option("checkpointLocation", state)
        .outputMode("append")
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return _triggered(writer, every).start()


def start_per_batch(
    stream: DataFrame,
    action: Callable[[DataFrame, int], None],
    state: str,
    every: str | None = None,
) -> StreamingQuery:
    writer = (
        stream.writeStream.foreachBatch(action)
        .option("checkpointLocation", state)
        .outputMode("append")
    )
    return _triggered(writer, every).start()


def _triggered(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def batch_key(spark: SparkSession, state: str, batch_id: int) -> str:
    """A batch's name, the same when it runs again; a new ``state`` gives new names."""
    (line,) = spark.read.text(f"{state}/metadata").first()
    return f"{json.loads(line)['id']}-{batch_id}"


def store_readings(stream: DataFrame, folder: str, state: str, every: str | None = None):
    """Append readings, by day, keeping the event time of each."""
    return start_to_folder(
        sinks.storable(stream), folder, state, partition_by="recorded_date", every=every
    )


def rule_alerts(
    stream: DataFrame,
    current_rules: Callable[[DataFrame], DataFrame],
    table: CommittedTable,
    state: str,
    every: str | None = None,
) -> StreamingQuery:
    """Every reading against the rules as they are when its batch runs: one row per rule and
    metric with how often, when and how high the batch tripped it.

    Rules are read again per micro-batch: ``current_rules`` gets its readings and gives the rules
    at their locations. A batch run twice is committed once.
    """

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        hits = rules.trip_history(current_rules(batch), batch)
        table.append(hits, batch_key(batch.sparkSession, state, batch_id))

    return start_per_batch(stream, evaluate, state, every)


# The rows that ``rule_alerts`` stores.
TRIPS = (
    "alert_id BIGINT, user_id BIGINT, username STRING, location STRING, alert_type STRING, "
    "severity STRING, message STRING, metric STRING, threshold DOUBLE, trips BIGINT, "
    "first_tripped_at TIMESTAMP, last_tripped_at TIMESTAMP, peak DOUBLE"
)


def live_update(
    stream: DataFrame,
    current_locations: Callable[[], DataFrame],
    current_rules: Callable[[DataFrame], DataFrame],
    model: PipelineModel | None,
    score: float | None,
    table: CommittedTable,
    feed: CommittedTable,
    state: str,
    every: str | None = TICK,
    latest: LatestReadings | None = None,
) -> StreamingQuery:
    """Per micro-batch: keep tracked locations, store, take into the latest readings, score,
    publish, warn.

    The stored table, the latest readings and the feed each commit a batch once, by its key, so
    that a batch run again after a failure does what is still missing and nothing twice.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(batch.sparkSession, state, batch_id)
        locations = settled(current_locations(), "locations")
        kept = joins.tracked_readings(batch, locations).persist()
        try:
            table.append(sinks.storable(kept), key)
            if latest is not None:
                latest.merge(sinks.storable(kept), key)
            if not feed.commits.has(key):
                published = (
                    sinks.weather_updates(scored(kept, model, score))
                    .unionByName(sinks.warnings_raised(rules.fixed_warnings(kept)))
                    .unionByName(sinks.rules_tripped(rules.trip_history(current_rules(kept), kept)))
                )
                feed.append(published, key)
        finally:
            kept.unpersist()

    return start_per_batch(stream, update, state, every)


def scored(readings: DataFrame, model: PipelineModel | None, score: float | None) -> DataFrame:
    if model is not None:
        return forecast.predict(model, readings, score)
    return readings.withColumns(
        {
            "predicted_temperature": F.lit(None).cast("double"),
            "confidence": F.lit(None).cast("double"),
            "predicted_for": F.lit(None).cast("timestamp"),
        }
    )
