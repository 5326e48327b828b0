"""The four tables: read as stored, or derived from the driver's star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.functions.nested import json_object


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    weather: DataFrame
    activities: DataFrame
    alerts: DataFrame


def stored_tables(spark: SparkSession, folder: str) -> Tables:
    """Scan the four tables with their declared schemas; nothing is inferred."""

    def scan(name: str) -> DataFrame:
        return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")

    return Tables(
        users=scan("users"),
        weather=scan("weather_data"),
        activities=scan("user_activities"),
        alerts=scan("weather_alerts"),
    )


# Columns of the driver tables that the views below read.
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT"
NATION = "n_nationkey INT, n_name STRING"
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)


def driver_table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{folder}/{name}.parquet")


def driver_tables(spark: SparkSession, folder: str) -> Tables:
    """The four tables as views over ``events``, ``customer``, ``nation`` and ``orders``."""
    orders = driver_table(spark, folder, "orders", ORDERS)
    return Tables(
        users=users_from(
            driver_table(spark, folder, "customer", CUSTOMER),
            driver_table(spark, folder, "nation", NATION),
        ),
        weather=weather_from(driver_table(spark, folder, "events", EVENTS)),
        activities=activities_from(orders),
        alerts=alerts_from(orders),
    )


def weather_from(events: DataFrame) -> DataFrame:
    """Readings; works on a batch and on a stream of events."""
    hundredths = F.floor(F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("event_id").alias("data_id"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("location"),
        ((hundredths % 4500) / F.lit(100.0) - F.lit(5.0)).alias("temperature"),
        F.get_json_object("props", "$.k").cast("double").alias("humidity"),
        (990 + (F.col("event_id") * 13) % 50).cast("double").alias("pressure"),
        ((F.col("event_id") * 11) % 65).cast("double").alias("wind_speed"),
        F.when(F.col("event_type") == "click", "Sunny")
        .when(F.col("event_type") == "view", "Cloudy")
        .when(F.col("event_type") == "error", "Rainy")
        .when(F.col("event_type") == "signup", "Clear")
        .otherwise("Windy")
        .alias("weather_condition"),
        ((F.col("event_id") * 5) % 15).cast("double").alias("precipitation"),
        F.col("ts").alias("recorded_at"),
    )


def users_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    range_shape = json_object(
        F.array(F.lit("walking"), F.lit("cycling"), F.lit("reading")).alias(
            "preferred_activities"
        ),
        F.array(F.lit(15), F.lit(25)).alias("temperature_range"),
        F.lit(True).alias("avoid_rain"),
        F.lit(True).alias("avoid_extreme_wind"),
    )
    form_shape = json_object(
        F.array(_one_of(key % 3, "walking", "running", "cycling")).alias("preferred_activities"),
        (5 + key % 10).alias("temperature_min"),
        (20 + key % 12).alias("temperature_max"),
        (key % 2 == 0).alias("avoid_rain"),
        F.lit(True).alias("avoid_extreme_heat"),
    )
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        key.alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))), F.lit("@example.com")).alias(
            "email"
        ),
        F.col("n_name").alias("location"),
        F.when(key % 10 == 1, range_shape).when(key % 10 != 0, form_shape).alias("preferences"),
        (
            F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_interval(days=(key % 365).cast("int"))
        ).alias("created_at"),
    )


def activities_from(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return orders.select(
        key.alias("activity_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(priority == "1-URGENT", "running")
        .when(priority == "2-HIGH", "cycling")
        .when(priority == "3-MEDIUM", "walking")
        .when(priority == "5-LOW", "reading")
        .otherwise("gardening")
        .alias("activity_type"),
        F.when(status == "F", "Sunny")
        .when(status == "O", "Cloudy")
        .otherwise("Rainy")
        .alias("weather_condition"),
        (10 + key % 110).cast("int").alias("duration_minutes"),
        (1 + key % 5).cast("int").alias("satisfaction_rating"),
        F.col("o_orderdate").alias("activity_date"),
        F.lit(None).cast("string").alias("notes"),
    )


def alerts_from(orders: DataFrame) -> DataFrame:
    """Every order is one stored alert rule."""
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    return orders.select(
        key.alias("alert_id"),
        F.col("o_custkey").alias("user_id"),
        _one_of(key % 3, "Temperature", "Wind", "Rain").alias("alert_type"),
        F.when(priority == "1-URGENT", "Critical")
        .when(priority == "2-HIGH", "High")
        .when(priority == "3-MEDIUM", "Medium")
        .otherwise("Low")
        .alias("severity"),
        F.concat(F.lit("alert "), key.cast("string")).alias("message"),
        json_object(
            (25 + key % 15).cast("double").alias("temperature"),
            F.lit(50.0).alias("wind_speed"),
            F.lit(10.0).alias("precipitation"),
        ).alias("trigger_conditions"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.col("o_orderdate").alias("created_at"),
    )


def _one_of(index: Column, first: str, second: str, third: str) -> Column:
    return F.when(index == 0, first).when(index == 1, second).otherwise(third)
