"""Training data and the train, evaluate, predict sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyvane.operators import forecast, lookups, windows
from skyvane.sources.tables import Tables


def training_data(tables: Tables, location: str, as_of: str, hours: int) -> DataFrame:
    """Features and targets of one location and window; none below the minimum history."""
    recent = lookups.since(lookups.at_location(tables.weather, location), as_of, hours)
    return forecast.training_pairs(lookups.with_enough_history(recent))


def current_with_prediction(
    training: forecast.Training, tables: Tables, location: str = "London"
) -> DataFrame:
    """The newest reading of one location with the prediction after it."""
    at_place = lookups.at_location(tables.weather, location)
    latest = windows.latest_per_location(at_place)
    return forecast.predict(training.model, latest, training.score)


def next_predictions(training: forecast.Training, tables: Tables) -> DataFrame:
    """Prediction after the newest reading of every location."""
    latest = windows.latest_per_location(tables.weather)
    return forecast.predict(training.model, latest, training.score)
