"""Landed answers of the weather service -> flat readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas

# The reading stored when an answer cannot be used.
FALLBACK = {
    "temperature": 20.0,
    "humidity": 65.0,
    "pressure": 1013.0,
    "wind_speed": 10.0,
    "weather_condition": "Sunny",
}


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED_PAYLOAD).json(folder)


def landed_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """New files as they land; ``files_per_batch`` bounds what one micro-batch takes on."""
    reader = spark.readStream.schema(schemas.LANDED_PAYLOAD)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def parsed(payloads: DataFrame) -> DataFrame:
    """Flat columns of each answer, null where the answer lacks them."""
    body = payloads.withColumn("answer", F.from_json("body", schemas.PAYLOAD_BODY))
    return body.select(
        F.col("reading_id").alias("data_id"),
        "location",
        "status",
        F.col("answer.main.temp").alias("temperature"),
        F.col("answer.main.humidity").alias("humidity"),
        F.col("answer.main.pressure").alias("pressure"),
        F.col("answer.wind.speed").alias("wind_speed"),
        F.get(F.col("answer.weather"), F.lit(0))["main"].alias("weather_condition"),
        F.col("answer.rain.1h").alias("precipitation"),
        F.col("received_at").alias("recorded_at"),
    )


def readings(payloads: DataFrame) -> DataFrame:
    """Readings to store. An answer that failed or lacks any required field is replaced by
    the whole fallback record and flagged; rain is 0 where the answer names none."""
    flat = parsed(payloads)
    usable = F.coalesce(F.col("status") == 200, F.lit(False))
    for column in FALLBACK:
        usable = usable & F.col(column).isNotNull()
    replaced = {
        column: F.when(usable, F.col(column)).otherwise(F.lit(value))
        for column, value in FALLBACK.items()
    }
    replaced["precipitation"] = F.when(
        usable, F.coalesce("precipitation", F.lit(0.0))
    ).otherwise(F.lit(0.0))
    return flat.select(
        "data_id",
        "location",
        *(value.alias(column) for column, value in replaced.items()),
        "recorded_at",
        (~usable).alias("is_fallback"),
    )
