"""Training, scoring and storing models. Fitted forests differ between libraries, so what is
compared is all that the data fix: rows, times, counts, targets, and the bounds that a model's
numbers must keep."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.checks.base_views import LATEST
from skyvane.checks.composites import PAIRS
from skyvane.checks.registry import AS_OF, PLACE, register, register_all
from skyvane.functions import labels
from skyvane.operators import aggregates, forecast, lookups, trees
from skyvane.plans import dashboard, training
from skyvane.session import shared_folder
from skyvane.sources.models import ModelRegistry
from skyvane.sources.tables import driver_tables

HISTORY_HOURS = 720
# A window with too few readings to train on, and the pairs that a location needs for its model.
TOO_FEW_HOURS = 1
LOCATION_MINIMUM = 19
# Bounds of a shown confidence, and how far a sum's order or a shown decimal moves a figure.
CONFIDENCE = (0.6, 0.95)
ROUNDING, SHOWN_ROUNDING, SCORE_ROUNDING = 1e-9, 0.05 + 1e-9, 0.0005 + 1e-6

IS_TEST = "CAST('0x' || substr(md5(CAST(data_id AS VARCHAR)), 1, 6) AS BIGINT) % 5 = 0"
KNOWN = " AND ".join(
    f"{name} IS NOT NULL"
    for name in ("temperature", "humidity", "pressure", "wind_speed", "recorded_at")
)
ALL_PAIRS = f", history AS (SELECT * FROM weather_data), {PAIRS}"

_trained: dict[tuple[str, str], forecast.Training] = {}


def trained(spark: SparkSession, folder: str) -> forecast.Training:
    """One model per session and folder, shared by the queries below."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _trained:
        weather = driver_tables(spark, folder).weather
        _trained[key] = forecast.retrain(weather, AS_OF, hours=HISTORY_HOURS)
    return _trained[key]


register_all(
    {
        "m2_feature_statistics": (
            lambda t: aggregates.column_statistics(
                forecast.training_pairs(t.weather), forecast.FEATURES
            ).select(
                "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
            ),
            ALL_PAIRS
            + " UNION ALL ".join(
                f"SELECT '{feature}' AS feature, round(avg({feature}), 6) AS mean, "
                f"round(stddev_pop({feature}), 6) AS std FROM pairs WHERE target IS NOT NULL"
                for feature in forecast.FEATURES
            ),
        ),
        "m3_train_test_split": (
            lambda t: t.weather.select(
                "data_id", forecast.is_test_row(F.col("data_id")).alias("is_test")
            ),
            f"SELECT data_id, {IS_TEST} AS is_test FROM weather_data",
        ),
        "a9_r_squared": (
            lambda t: aggregates.regression_metrics(
                forecast.persistence(
                    forecast.training_pairs(t.weather)
                ),
                "target",
                "prediction",
            ).select("n", F.round("r2", 6).alias("r2")),
            f"""
            , history AS (SELECT * FROM weather_data), {PAIRS}
            SELECT count(*) AS n,
                   round(1 - sum((target - temperature) ** 2)
                           / sum((target - (SELECT avg(target) FROM pairs)) ** 2), 6) AS r2
            FROM pairs WHERE target IS NOT NULL
            """,
        ),
    }
)


def _among_targets(spark, folder: str, prediction: str, slack: float) -> Column:
    """Whether a prediction lies between the least and the largest target of the training rows,
    whose means a forest gives."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    seen = pairs.where(~forecast.is_test_row(F.col("data_id")))
    ends = seen.agg(
        F.struct((F.min("target") - slack).alias("low"), (F.max("target") + slack).alias("high"))
    ).scalar()
    return F.col(prediction).between(ends["low"], ends["high"]).alias("among_targets")


def _beats_persistence(measured: DataFrame, spark, folder: str) -> DataFrame:
    """Add the error of the forecast that the next reading is like this one, on the hold-out
    rows, and whether the measured error is below it."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    held_out = pairs.where(forecast.is_test_row(F.col("data_id")))
    simple = aggregates.regression_metrics(
        forecast.persistence(held_out), "target", "prediction"
    ).select("rmse").scalar()
    return measured.withColumns(
        {
            "persistence_rmse": F.round(simple, 6),
            "beats_persistence": F.col("rmse") < simple,
        }
    )


def _predictions(spark, folder: str) -> DataFrame:
    """Predictions of the forest next to the targets, for every pair."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    return trained(spark, folder).model.transform(pairs).select("data_id", "target", "prediction")


def _forest(spark, folder: str) -> DataFrame:
    return _predictions(spark, folder).select(
        "data_id", "target", _among_targets(spark, folder, "prediction", ROUNDING)
    )


def _stored_model(spark, folder: str) -> str:
    """The folder that the registry keeps the shared model in."""
    return registry(spark, folder).current_run().first().model


def _gappy_readings(spark, folder: str) -> DataFrame:
    """Readings with features, some of them missing."""
    features = forecast.with_features(driver_tables(spark, folder).weather)
    row = F.col("data_id")
    return features.withColumns(
        {
            "humidity": F.when(row % 13 != 0, F.col("humidity")),
            "temperature": F.when(row % 17 != 0, F.col("temperature")),
        }
    )


def _different(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that either side has, and those on which ``prediction`` differs."""
    a, b = F.col("a"), F.col("b")
    same = F.coalesce(F.abs(a - b) <= ROUNDING * F.greatest(F.lit(1.0), F.abs(b)), F.lit(False))
    return (
        left.select("data_id", F.col("prediction").alias("a"))
        .join(right.select("data_id", F.col("prediction").alias("b")), "data_id", "full")
        .agg(F.count("*").alias("n_rows"), F.count_if(~same).alias("n_different"))
    )


def _descent(spark, folder: str) -> DataFrame:
    """The stored forest, followed node by node, against the library."""
    rows = _gappy_readings(spark, folder)
    own = trees.predicted(spark, _stored_model(spark, folder), rows, forecast.FEATURES)
    return _different(own, trained(spark, folder).model.transform(rows))


def _evaluation(spark, folder: str) -> DataFrame:
    """The hold-out rows scored by the descent: whether that gives the score of the run, and
    whether the error is below that of persistence."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    held_out = pairs.where(forecast.is_test_row(F.col("data_id")))
    scored = trees.predicted(spark, _stored_model(spark, folder), held_out, forecast.FEATURES)
    score = trained(spark, folder).score
    measured = aggregates.regression_metrics(scored, "target", "prediction")
    return _beats_persistence(measured, spark, folder).select(
        "n",
        (F.abs(F.col("r2") - score) <= ROUNDING).alias("score_holds"),
        "persistence_rmse",
        "beats_persistence",
    )


def _fixed(predicted: DataFrame, spark, folder: str) -> DataFrame:
    """What the data fix about shown predictions."""
    return predicted.select(
        "data_id",
        "location",
        "predicted_for",
        _among_targets(spark, folder, "predicted_temperature", SHOWN_ROUNDING),
        F.col("confidence").between(*CONFIDENCE).alias("confidence_in_bounds"),
    )


def _fixed_sql(readings: str) -> str:
    return f"""
    SELECT data_id, location,
           CASE WHEN {KNOWN} THEN recorded_at + INTERVAL 1 HOUR END AS predicted_for,
           CASE WHEN {KNOWN} THEN true END AS among_targets,
           CASE WHEN {KNOWN} THEN true END AS confidence_in_bounds
    FROM {readings}
    """


def _scored_readings(spark, folder: str) -> DataFrame:
    fitted = trained(spark, folder)
    weather = driver_tables(spark, folder).weather
    return forecast.predict(fitted.model, weather, fitted.score)


def _record(runs: DataFrame, training: forecast.Training, pairs: DataFrame) -> DataFrame:
    """Run records with, in place of their figures, whether these hold on the hold-out rows."""
    holds = F.lit(None).cast("boolean")
    if training.model is not None:
        held_out = pairs.where(forecast.is_test_row(F.col("data_id")))
        again = aggregates.regression_metrics(
            training.model.transform(held_out), "target", "prediction"
        )
        score = again.select("r2").scalar()
        holds = (F.abs(F.col("score") - score) <= SCORE_ROUNDING) & (F.col("mae") <= F.col("rmse"))
    return runs.select(
        F.col("trained_at").cast("timestamp_ntz").alias("trained_at"),
        "locations",
        "data_points",
        "train_rows",
        "status",
        holds.alias("figures_hold"),
    )


def _window_sql(hours: int) -> str:
    return f"""
    , recent AS (
      SELECT * FROM weather_data
      WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOURS
    ),
    history AS (
      SELECT * FROM recent WHERE location IN (
        SELECT location FROM recent GROUP BY location HAVING count(*) >= 20)
    ),
    {PAIRS}
    """


def _record_sql(pairs: str, locations: str) -> str:
    return f"""
    {pairs}, counted AS (
      SELECT count(*) AS n, count(*) FILTER (WHERE NOT {IS_TEST}) AS n_train
      FROM pairs WHERE target IS NOT NULL AND {KNOWN.replace("pressure", "pressure_scaled")}
    )
    SELECT TIMESTAMP '{AS_OF}' AS trained_at, '{locations}' AS locations, n AS data_points,
           CASE WHEN n >= 19 THEN n_train ELSE 0 END AS train_rows,
           CASE WHEN n >= 19 THEN 'trained' ELSE 'too little data' END AS status,
           CASE WHEN n >= 19 THEN true END AS figures_hold
    FROM counted
    """


def _training_run(spark, folder: str) -> DataFrame:
    """A run over the usual window."""
    weather = driver_tables(spark, folder).weather
    fitted = forecast.retrain(weather, AS_OF)
    recent = lookups.since(weather, AS_OF, forecast.TRAINING_HOURS)
    return _record(fitted.run, fitted, forecast.training_pairs(lookups.with_enough_history(recent)))


def _ensured(spark, folder: str) -> DataFrame:
    """The status when a model is there and when a window holds too little data, and whether the
    model that is there is the one returned, and none else."""
    weather = driver_tables(spark, folder).weather
    model = trained(spark, folder).model
    present = forecast.ensure_trained(model, weather, AS_OF)
    lacking = forecast.ensure_trained(None, lookups.since(weather, AS_OF, 1), AS_OF)
    held = F.lit(present.model is model)
    return present.run.withColumn("as_found", held).unionByName(
        lacking.run.withColumn("as_found", F.lit(lacking.model is None))
    ).select("status", "as_found")


def _round_trip(spark, folder: str) -> DataFrame:
    """Rows that either model gives, and those on which the stored and reloaded one disagrees
    with the one in memory."""
    fitted = trained(spark, folder)
    target = shared_folder(spark, "model")
    forecast.saved_model(fitted.model, target)
    readings = forecast.with_features(driver_tables(spark, folder).weather)
    before = fitted.model.transform(readings).select("data_id", F.col("prediction").alias("before"))
    after = forecast.loaded_model(spark, target).transform(readings)
    return (
        after.select("data_id", F.col("prediction").alias("after"))
        .join(before, "data_id", "full")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different"),
        )
    )


_registries: dict[tuple[str, str], ModelRegistry] = {}


def registry(spark: SparkSession, folder: str) -> ModelRegistry:
    """A registry with the shared model, one per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _registries:
        _registries[key] = ModelRegistry(spark, shared_folder(spark, "registry"))
        _registries[key].record(trained(spark, folder))
    return _registries[key]


def _summary(spark, folder: str) -> DataFrame:
    return dashboard.summary(driver_tables(spark, folder), registry(spark, folder))


def _summary_row(spark, folder: str) -> DataFrame:
    """The summary of a registry in which a run has failed after the one that made a model."""
    tables = driver_tables(spark, folder)
    own = ModelRegistry(spark, shared_folder(spark, "registry"))
    own.record(trained(spark, folder))
    own.record(forecast.retrain(tables.weather, AS_OF, hours=TOO_FEW_HOURS))
    return aggregates.summary(tables.users, tables.activities, tables.alerts, own.is_trained())


def _status_over_runs(spark, folder: str) -> DataFrame:
    """The status after each of three runs: over too short a window, over the usual one, and over
    too short a window again; and how many readings the current model has seen."""
    weather = driver_tables(spark, folder).weather
    own = ModelRegistry(spark, shared_folder(spark, "registry"))
    after = []
    for number in (1, 2, 3):
        made = forecast.retrain(weather, AS_OF, hours=TOO_FEW_HOURS) if number != 2 else None
        own.record(made or trained(spark, folder))
        state = own.is_trained().select(labels.model_status(F.col("is_trained")).alias("model_status"))
        seen = own.current_run().select("data_points").scalar()
        after.append(state.select(F.lit(number).alias("run"), "*", seen.alias("data_points")))
    return reduce(DataFrame.unionByName, after)


def _recorded_runs(spark, folder: str) -> DataFrame:
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    return _record(registry(spark, folder).runs(), trained(spark, folder), pairs)


def _status_panel(spark, folder: str) -> DataFrame:
    panel = forecast.status_panel(registry(spark, folder).runs(), _scored_readings(spark, folder))
    score = trained(spark, folder).score
    return panel.select(
        "locations",
        F.col("last_training").cast("timestamp_ntz").alias("last_training"),
        "data_points",
        "predictions_made",
        (F.abs(F.col("score") - score) <= SCORE_ROUNDING).alias("score_holds"),
    )


def _next_predictions(spark, folder: str) -> DataFrame:
    """Trains anew, so that timing this query times the training."""
    tables = driver_tables(spark, folder)
    fitted = forecast.retrain(tables.weather, AS_OF, hours=HISTORY_HOURS)
    return training.next_predictions(fitted, tables)


def _current_with_prediction(spark, folder: str) -> DataFrame:
    return training.current_with_prediction(
        trained(spark, folder), driver_tables(spark, folder), PLACE
    )


def _by_location(spark, folder: str) -> DataFrame:
    """The run that gives every location a model, and whether its figures are met again."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    fitted = forecast.train_by_location(pairs, AS_OF)
    held_out = pairs.where(forecast.is_test_row(F.col("data_id")))
    again = aggregates.regression_metrics(
        forecast.predict_by_location(fitted.models, held_out).where("prediction IS NOT NULL"),
        "target",
        "prediction",
    )
    score = again.select("r2").scalar()
    return fitted.run.select(
        F.col("trained_at").cast("timestamp_ntz").alias("trained_at"),
        "locations",
        "data_points",
        "train_rows",
        "status",
        ((F.abs(F.col("score") - score) <= SCORE_ROUNDING) & (F.col("mae") <= F.col("rmse"))).alias(
            "figures_hold"
        ),
    )


def _location_pairs(spark, folder: str) -> DataFrame:
    """Pairs, of which one location has only those of its first two days."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    is_short = (F.col("location") == PLACE) & (F.col("recorded_at") >= "2024-01-03")
    return pairs.where(~is_short)


def _location_models(spark, folder: str) -> DataFrame:
    """A model for every location, its rows, and whether its residuals vanish on the whole and
    against every feature."""
    pairs = _location_pairs(spark, folder)
    models = forecast.location_models(pairs, minimum=LOCATION_MINIMUM)
    residual = F.col("target") - F.col("prediction")
    against = [F.lit(1.0), *(F.col(name) for name in forecast.FEATURES)]
    left = [F.abs(F.sum(residual * x)) <= 1e-7 * F.sum(1 + F.abs(x)) for x in against]
    vanish = (
        forecast.predict_by_location(models, pairs)
        .groupBy("location")
        .agg(*(good.alias(f"_{i}") for i, good in enumerate(left)))
    )
    every = reduce(Column.__and__, (F.col(f"_{i}") for i in range(len(left))))
    vanish = vanish.select("location", every.alias("residuals_vanish"))
    return models.join(vanish, "location").select("location", "n", "status", "residuals_vanish")


def _location_trends(spark, folder: str) -> DataFrame:
    """Models of the temperature alone, whose numbers SQL gives as well."""
    models = forecast.location_models(
        _location_pairs(spark, folder), ["temperature"], LOCATION_MINIMUM
    )
    return models.select(
        "location",
        "n",
        F.round("intercept", 6).alias("intercept"),
        F.round(F.get("coefficients", F.lit(0)), 6).alias("slope"),
    )


def _other_target(name: str, steps: int = 1, target: str = "temperature"):
    def run(spark, folder: str) -> DataFrame:
        weather = driver_tables(spark, folder).weather
        pairs = forecast.training_pairs(weather, steps=steps, target=target)
        fitted = forecast.train(pairs, AS_OF, name)
        return _record(fitted.run, fitted, pairs)

    return run


def _ensemble(spark, folder: str) -> DataFrame:
    """The hold-out rows, those on which the ensemble is not the mean of its members, each
    followed node by node, and whether it beats persistence."""
    pairs = forecast.training_pairs(driver_tables(spark, folder).weather)
    boosted = forecast.train(
        pairs, AS_OF, "boosted", pipeline=forecast.boosted_trees(forecast.FEATURES)
    )
    stored = shared_folder(spark, "boosted")
    forecast.saved_model(boosted.model, stored)
    both = [trained(spark, folder).model, boosted.model]
    held_out = pairs.where(forecast.is_test_row(F.col("data_id")))
    together = forecast.ensemble(both, held_out)
    members = trees.predicted(
        spark, _stored_model(spark, folder), held_out, forecast.FEATURES, "first"
    )
    members = trees.predicted(spark, stored, members, forecast.FEATURES, "second")
    mean = members.withColumn("prediction", (F.col("first") + F.col("second")) / 2)
    measured = aggregates.regression_metrics(together, "target", "prediction")
    return _beats_persistence(measured, spark, folder).select(
        "n",
        _different(mean, together).select("n_different").scalar().alias("n_different"),
        "persistence_rmse",
        "beats_persistence",
    )


def _fixed_of(predicted):
    return lambda spark, folder: _fixed(predicted(spark, folder), spark, folder)


PERSISTENCE = """
round(sqrt(avg((target - temperature) ** 2)), 6) AS persistence_rmse, true AS beats_persistence
"""
HELD_OUT = f"FROM pairs WHERE target IS NOT NULL AND {IS_TEST}"

register(
    "m4_forest_predictions",
    _forest,
    f"{ALL_PAIRS} SELECT data_id, target, true AS among_targets FROM pairs WHERE target IS NOT NULL",
)
register(
    "m5_evaluation",
    _evaluation,
    f"""
    {ALL_PAIRS} SELECT count(*) AS n, true AS score_holds, {PERSISTENCE} {HELD_OUT}
    """,
)
register("m6_scored_readings", _fixed_of(_scored_readings), _fixed_sql("weather_data"))
register(
    "m7_retrain_run", _training_run, _record_sql(_window_sql(forecast.TRAINING_HOURS), "all")
)
register(
    "m8_train_only_when_needed",
    _ensured,
    """
    SELECT unnest(['already trained', 'too little data']) AS status, true AS as_found
    """,
)
register(
    "s12_model_round_trip",
    _round_trip,
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM weather_data",
)
register("s13_training_runs", _recorded_runs, _record_sql(_window_sql(HISTORY_HOURS), "all"))
register(
    "q10_train_evaluate_predict",
    _fixed_of(_next_predictions),
    f", {LATEST} {_fixed_sql('latest')}",
)
register(
    "t5_current_with_prediction",
    _fixed_of(_current_with_prediction),
    f""", {LATEST} {_fixed_sql(f"latest WHERE location = '{PLACE}'")}""",
)
register(
    "d11_train_24_ahead",
    _other_target("24 readings ahead", steps=24),
    _record_sql(
        ALL_PAIRS.replace("lead(temperature)", "lead(temperature, 24)"), "24 readings ahead"
    ),
)
register(
    "d14_status_panel",
    _status_panel,
    f"""
    {_window_sql(HISTORY_HOURS)}
    SELECT 'all' AS locations, TIMESTAMP '{AS_OF}' AS last_training,
           (SELECT count(*) FROM pairs WHERE target IS NOT NULL) AS data_points,
           (SELECT count(*) FROM weather_data WHERE {KNOWN}) AS predictions_made,
           true AS score_holds
    """,
)
register("d15_model_by_location", _by_location, _record_sql(ALL_PAIRS, "all, by location"))
LOCATION_PAIRS = f"""
{ALL_PAIRS}, fitted AS (
  SELECT * FROM pairs WHERE target IS NOT NULL
    AND NOT (location = '{PLACE}' AND recorded_at >= TIMESTAMP '2024-01-03')
)
"""
register(
    "d15_location_models",
    _location_models,
    f"""
    {LOCATION_PAIRS}
    SELECT location, count(*) AS n,
           CASE WHEN count(*) >= {LOCATION_MINIMUM} THEN 'trained' ELSE 'too little data' END
             AS status,
           CASE WHEN count(*) >= {LOCATION_MINIMUM} THEN true END AS residuals_vanish
    FROM fitted GROUP BY location
    """,
)
register(
    "d15_location_trends",
    _location_trends,
    f"""
    {LOCATION_PAIRS}
    SELECT location, count(*) AS n,
           CASE WHEN count(*) >= {LOCATION_MINIMUM}
                THEN round(regr_intercept(target, temperature), 6) END AS intercept,
           CASE WHEN count(*) >= {LOCATION_MINIMUM}
                THEN round(regr_slope(target, temperature), 6) END AS slope
    FROM fitted GROUP BY location
    """,
)
register(
    "m4_descent_of_the_forest",
    _descent,
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM weather_data",
)
register(
    "d16_precipitation_model",
    _other_target("precipitation", target="precipitation"),
    _record_sql(
        ALL_PAIRS.replace("lead(temperature)", "lead(precipitation)"), "precipitation"
    ),
)
register(
    "d17_ensemble",
    _ensemble,
    f"""
    {ALL_PAIRS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different, {PERSISTENCE} {HELD_OUT}
    """,
)


def _pairs_sql(hours: int, name: str) -> str:
    """The complete pairs of a window, counted."""
    body = _window_sql(hours).strip().removeprefix(",")
    for own in ("recent", "history", "pairs"):
        body = re.sub(rf"\b{own}\b", f"{own}_{name}", body)
    known = KNOWN.replace("pressure", "pressure_scaled")
    return f"""
    {body}, counted_{name} AS (
      SELECT count(*) AS n FROM pairs_{name} WHERE target IS NOT NULL AND {known}
    )
    """


SUMMARY_SQL = f"""
, {_pairs_sql(HISTORY_HOURS, "whole")}
SELECT (SELECT count(*) FROM users) AS total_users,
       (SELECT count(*) FROM weather_alerts WHERE is_active) AS active_alerts,
       (SELECT count(*) FROM user_activities) AS total_activities,
       (SELECT CASE WHEN n >= 19 THEN 'Trained' ELSE 'Training' END FROM counted_whole)
         AS model_status
"""
register("q1_dashboard_summary", _summary, SUMMARY_SQL)
register("a7_summary_row", _summary_row, SUMMARY_SQL)
register(
    "h_cond_6_model_status",
    _status_over_runs,
    f"""
    , {_pairs_sql(HISTORY_HOURS, "whole")}, {_pairs_sql(TOO_FEW_HOURS, "brief")},
    runs AS (
      SELECT run, CASE WHEN run = 2 THEN (SELECT n FROM counted_whole)
                       ELSE (SELECT n FROM counted_brief) END AS n
      FROM range(1, 4) t(run)
    )
    SELECT CAST(a.run AS INTEGER) AS run,
           CASE WHEN max(b.n) FILTER (WHERE b.n >= 19) IS NOT NULL THEN 'Trained'
                ELSE 'Training' END AS model_status,
           max_by(b.n, b.run) FILTER (WHERE b.n >= 19) AS data_points
    FROM runs a JOIN runs b ON b.run <= a.run GROUP BY a.run
    """,
)
