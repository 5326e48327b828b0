"""The set of locations that are watched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Locations shown without any user or search.
DEFAULT_LOCATIONS = ("London", "New York", "Tokyo", "Paris", "Sydney")


def default_locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in DEFAULT_LOCATIONS], "location STRING")


def tracked_locations(*sources: DataFrame) -> DataFrame:
    """Union of location columns, trimmed, without blanks and repeats."""
    named = [source.select(F.trim("location").alias("location")) for source in sources]
    everything = reduce(DataFrame.unionByName, named)
    return everything.where(F.col("location") != "").distinct()
