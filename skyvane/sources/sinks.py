"""Written tables: appended readings, event feed rows, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.functions.times import iso_text

STORED_READING = (
    "data_id",
    "location",
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "weather_condition",
    "precipitation",
    "recorded_at",
)


def storable(readings: DataFrame) -> DataFrame:
    """The stored columns plus the day, by which the table is partitioned. Days grow slowly
    and evenly, where one folder per location would give very many or very uneven ones."""
    return readings.select(*STORED_READING).withColumns(
        {
            "recorded_at": F.col("recorded_at").cast("timestamp"),
            "recorded_date": F.to_date("recorded_at"),
        }
    )


def append_readings(readings: DataFrame, folder: str) -> None:
    """Append a batch. Rows are sorted by location and time inside their task only, so that
    file statistics skip other locations without any shuffle."""
    (
        storable(readings)
        .sortWithinPartitions("recorded_date", "location", "recorded_at")
        .write.mode("append")
        .partitionBy("recorded_date")
        .parquet(folder)
    )


def compact_readings(stored: DataFrame, folder: str, rows_per_file: int = 4_000_000) -> None:
    """Rewrite ``stored`` readings as a table in ``folder`` with few files a day.

    Rows are cut by range of day, location, time and id, so that short days share a task and
    neither a long day nor a single instant has to fit one. A run after a failure replaces
    what the failed one left; readers change to the new folder once it is written.
    """
    order = ("recorded_date", "location", "recorded_at", "data_id")
    (
        stored.select(*STORED_READING, "recorded_date")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("recorded_date")
        .parquet(folder)
    )


def stored_readings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{schemas.WEATHER_DATA}, recorded_date DATE").parquet(folder)


def export(df: DataFrame, folder: str, file_format: str) -> None:
    """CSV (with header) or JSON lines, one file per task."""
    writer = df.write.mode("errorifexists").option("header", True)
    writer.format(file_format).save(folder)


def feed_row(event: str, *payload: Column) -> list[Column]:
    return [F.lit(event).alias("event"), F.to_json(F.struct(*payload)).alias("payload")]


def weather_updates(scored: DataFrame) -> DataFrame:
    """Feed rows for scored readings; the prediction is left out where there is none."""
    data = F.struct(
        "temperature",
        "humidity",
        "pressure",
        "wind_speed",
        F.col("weather_condition").alias("condition"),
        "location",
        iso_text(F.col("recorded_at")).alias("timestamp"),
    )
    prediction = F.when(
        F.col("predicted_temperature").isNotNull(),
        F.struct(
            "predicted_temperature",
            "confidence",
            iso_text(F.col("predicted_for")).alias("timestamp"),
        ),
    )
    return scored.select(
        *feed_row(
            "weather_update", F.col("location"), data.alias("data"), prediction.alias("prediction")
        )
    )


def users_added(users: DataFrame) -> DataFrame:
    return users.select(
        *feed_row(
            "user_added",
            F.col("username"),
            F.col("location"),
            iso_text(F.col("created_at")).alias("timestamp"),
        )
    )


def alerts_created(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        *feed_row(
            "alert_created",
            F.col("user_id"),
            F.col("alert_type"),
            F.col("severity"),
            F.col("message"),
            iso_text(F.col("created_at")).alias("timestamp"),
        )
    )


def rules_tripped(hits: DataFrame) -> DataFrame:
    return hits.select(
        *feed_row(
            "alert_tripped",
            F.col("alert_id"),
            F.col("user_id"),
            F.col("location"),
            F.col("severity"),
            F.col("message"),
            F.col("metric"),
            F.col("threshold"),
            F.col("trips"),
            F.col("peak"),
            iso_text(F.col("last_tripped_at")).alias("timestamp"),
        )
    )


def warnings_raised(warnings: DataFrame) -> DataFrame:
    return warnings.select(
        *feed_row(
            "warning",
            F.col("location"),
            F.col("title"),
            F.col("message"),
            F.col("level"),
            iso_text(F.col("recorded_at")).alias("timestamp"),
        )
    )
