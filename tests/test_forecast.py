from __future__ import annotations

import datetime
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.operators import aggregates, forecast, trees
from skyvane.sources.models import ModelRegistry

START = datetime.datetime(2024, 1, 1)


def series(spark, n, place="a", gap=None):
    rnd = random.Random(n)
    rows = [
        (
            i,
            place,
            None if i == gap else 10.0 + (i % 24) / 2 + rnd.random(),
            60.0,
            1000.0 + i % 20,
            float(i % 9),
            "Sunny",
            0.0,
            START + datetime.timedelta(hours=i),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, schemas.WEATHER_DATA)


AS_OF = "2024-01-08 00:00:00"


@pytest.fixture(scope="module")
def fitted(spark):
    return forecast.retrain(series(spark, 160), AS_OF)


def test_nineteen_readings_are_too_few(spark):
    training = forecast.retrain(series(spark, 19), AS_OF)
    assert training.model is None
    assert training.run.first().status == "too little data"


def test_twenty_readings_give_nineteen_pairs(spark):
    training = forecast.retrain(series(spark, 20), AS_OF)
    assert training.model is not None
    assert training.run.first().data_points == 19


def test_only_asked_locations_are_used(spark):
    both = series(spark, 40, "a").unionByName(
        series(spark, 60, "b").withColumn("data_id", F.col("data_id") + 1000)
    )
    assert forecast.retrain(both, AS_OF, ["b"]).run.first().data_points == 59


def test_missing_next_temperature_drops_the_pair(spark):
    pairs = forecast.training_pairs(series(spark, 30, gap=12))
    ids = {row.data_id for row in pairs.collect()}
    assert ids == set(range(29)) - {11}


def test_features_are_scaled_and_dated(spark):
    row = forecast.training_pairs(series(spark, 30)).where("data_id = 25").first()
    assert (row.pressure_scaled, row.hour, row.day_of_week, row.month) == (10.05, 1, 2, 1)


def test_formula_equals_the_evaluator(spark, fitted):
    scored = fitted.model.transform(forecast.training_pairs(series(spark, 160)))
    ours = aggregates.regression_metrics(scored, "target", "prediction").first()
    for name in ("r2", "mae", "rmse"):
        evaluator = RegressionEvaluator(labelCol="target", metricName=name)
        assert getattr(ours, name) == pytest.approx(evaluator.evaluate(scored))


def test_same_seed_same_predictions(spark, fitted):
    again = forecast.retrain(series(spark, 160), AS_OF)
    readings = series(spark, 30)

    def predictions(training):
        scored = forecast.predict(training.model, readings, training.score)
        return [row.predicted_temperature for row in scored.orderBy("data_id").collect()]

    assert predictions(fitted) == predictions(again)


def test_stored_model_predicts_the_same(spark, fitted, tmp_path):
    folder = str(tmp_path / "model")
    assert forecast.loaded_model(spark, folder) is None
    forecast.saved_model(fitted.model, folder)
    loaded = forecast.loaded_model(spark, folder)
    readings = forecast.with_features(series(spark, 30))
    before = [r.prediction for r in fitted.model.transform(readings).orderBy("data_id").collect()]
    after = [r.prediction for r in loaded.transform(readings).orderBy("data_id").collect()]
    assert before == after


def test_prediction_fields(spark, fitted):
    scored = forecast.predict(fitted.model, series(spark, 30, gap=3), fitted.score)
    rows = {row.data_id: row for row in scored.collect()}
    assert rows[3].predicted_temperature is None and rows[3].confidence is None
    assert rows[4].predicted_for == START + datetime.timedelta(hours=5)
    assert 0.6 <= rows[4].confidence <= 0.95
    assert rows[4].predicted_temperature == round(rows[4].predicted_temperature, 1)


def test_trains_only_without_a_model(spark, fitted):
    kept = forecast.ensure_trained(fitted.model, series(spark, 40), AS_OF)
    assert kept.model is fitted.model
    assert kept.run.first().status == "already trained"
    assert forecast.ensure_trained(None, series(spark, 40), AS_OF).run.first().status == "trained"


def test_runs_are_appended(spark, fitted, tmp_path):
    folder = str(tmp_path / "runs")
    forecast.append_run(fitted.run, folder)
    forecast.append_run(fitted.run, folder)
    runs = spark.read.schema(schemas.TRAINING_RUNS).parquet(folder).collect()
    assert len(runs) == 2 and runs[0].score == round(runs[0].score, 3)


def test_ensemble_is_the_mean(spark, fitted):
    pairs = forecast.training_pairs(series(spark, 60))
    alone = fitted.model.transform(pairs).select("data_id", F.col("prediction").alias("alone"))
    both = forecast.ensemble([fitted.model, fitted.model], pairs).join(alone, "data_id")
    assert both.where(F.abs(F.col("prediction") - F.col("alone")) > 1e-9).count() == 0


def several_places(spark):
    """Three places with enough pairs, of which one has constant and dependent features, and one
    with too few."""
    rnd = random.Random(4)
    rows = []
    for place, n in (("a", 60), ("b", 45), ("flat", 30), ("brief", 5)):
        for i in range(n):
            humidity, wind = rnd.random() * 50, rnd.random() * 20
            if place == "flat":
                humidity, wind = 3.0, 2 * float(i % 24) + 1
            target = 4 + 0.5 * humidity - 0.25 * wind + rnd.random()
            values = (float(i % 7), humidity, 10.0 + rnd.random(), wind, i % 24, i % 7 + 1, 1)
            rows.append((len(rows), place, *values, target))
    names = ", ".join(f"{name} DOUBLE" for name in forecast.FEATURES)
    rows = [(*row[:2], *map(float, row[2:])) for row in rows]
    return spark.createDataFrame(rows, f"data_id BIGINT, location STRING, {names}, target DOUBLE")


def test_location_models_are_least_squares(spark):
    import numpy as np

    pairs = several_places(spark)
    models = {r.location: r for r in forecast.location_models(pairs).collect()}
    assert (models["brief"].n, models["brief"].status) == (5, "too little data")
    assert models["brief"].coefficients is None and models["brief"].intercept is None
    predicted = {
        r.data_id: r.prediction
        for r in forecast.predict_by_location(forecast.location_models(pairs), pairs).collect()
    }
    rows = pairs.collect()
    for place in ("a", "b", "flat"):
        own = [r for r in rows if r.location == place]
        x = np.array([[1.0, *(r[name] for name in forecast.FEATURES)] for r in own])
        y = np.array([r.target for r in own])
        best = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert [predicted[r.data_id] for r in own] == pytest.approx(best.tolist(), abs=1e-8)
    assert models["flat"].coefficients[1] == 0 and models["flat"].coefficients[6] == 0
    assert all(predicted[r.data_id] is None for r in rows if r.location == "brief")


def test_model_of_a_place_without_spread_is_its_mean(spark):
    pairs = several_places(spark).where("location = 'a'").withColumns(
        {name: F.lit(1.0) for name in forecast.FEATURES}
    )
    (model,) = forecast.location_models(pairs).collect()
    mean = pairs.agg(F.avg("target")).first()[0]
    assert model.coefficients == [0.0] * 7 and model.intercept == pytest.approx(mean)


def test_location_run_without_a_model_says_so(spark):
    training = forecast.train_by_location(several_places(spark).where("location = 'brief'"), AS_OF)
    assert training.run.first().status == "too little data" and training.score is None


def test_descent_equals_the_library_on_odd_rows(spark, fitted, tmp_path):
    """Also where features are missing, no number, infinite, or at a threshold."""
    pairs = forecast.training_pairs(series(spark, 160))
    boosted = forecast.train(
        pairs, AS_OF, "b", pipeline=forecast.boosted_trees(forecast.FEATURES)
    ).model
    for number, model in enumerate((fitted.model, boosted)):
        folder = str(tmp_path / str(number))
        forecast.saved_model(model, folder)
        nodes = trees.node_table(spark, folder)
        assert nodes.where("left >= 0 AND threshold IS NULL").isEmpty()
        scaler = model.stages[1]
        inner = nodes.where("left >= 0").limit(200).collect()
        rows = [
            (k, *(float(scaler.mean[f]) if f != node.feature else
                  node.threshold * float(scaler.std[f]) + float(scaler.mean[f]) for f in range(7)))
            for k, node in enumerate(inner)
        ]
        odd = [None, float("nan"), float("inf"), -float("inf"), 0.0]
        rows += [(1000 + k, *(odd[(k + f) % 5] for f in range(7))) for k in range(5)]
        names = ", ".join(f"{name} DOUBLE" for name in forecast.FEATURES)
        given = spark.createDataFrame(rows, f"data_id BIGINT, {names}")
        own = trees.predicted(spark, folder, given, forecast.FEATURES).collect()
        library = model.transform(given).select("data_id", "prediction").collect()
        assert {r.data_id: r.prediction for r in own} == {
            r.data_id: pytest.approx(r.prediction, rel=1e-12) for r in library
        }


def test_descent_takes_rows_by_the_batch(spark, fitted, tmp_path):
    """No node of a tree is looked up by an expression of its own row."""
    folder = str(tmp_path / "model")
    forecast.saved_model(fitted.model, folder)
    rows = forecast.with_features(series(spark, 30))
    own = trees.predicted(spark, folder, rows, forecast.FEATURES)
    assert own.columns == [*rows.columns, "prediction"]
    assert "lambda" not in own._jdf.queryExecution().toString()
    assert trees.predicted(spark, folder, rows.limit(0), forecast.FEATURES).count() == 0


def test_parts_of_a_fit_are_not_those_of_the_shuffle(spark):
    """Every part sums up all nodes of a level, so that their number makes the work."""
    seen = []

    class Watched:
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return forecast.forest(forecast.FEATURES).fit(rows)

    pairs = forecast.training_pairs(series(spark, 400)).repartition(2 * forecast.PARTS, "data_id")
    training = forecast.train(pairs, AS_OF, "all", pipeline=Watched())
    assert seen == [forecast.PARTS] and training.run.first().data_points == 399


def test_registry_follows_the_newest_model(spark, fitted, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    lacking = forecast.retrain(series(spark, 10), AS_OF)

    def trained():
        return registry.is_trained().first().is_trained

    assert not trained() and registry.current() is None
    registry.record(lacking)
    assert not trained() and registry.current() is None
    assert registry.record(fitted, "first") and not registry.record(fitted, "first")
    assert trained() and registry.runs().count() == 2
    model, run = registry.current()
    assert run.status == "trained" and run.data_points == 159
    registry.record(lacking)
    registry.record(forecast.ensure_trained(model, series(spark, 40), AS_OF))
    assert registry.current()[1] == run and registry.runs().count() == 4
    readings = forecast.with_features(series(spark, 30))
    before = [r.prediction for r in fitted.model.transform(readings).orderBy("data_id").collect()]
    after = [r.prediction for r in model.transform(readings).orderBy("data_id").collect()]
    assert before == after
    registry.record(forecast.retrain(series(spark, 60), AS_OF))
    assert registry.current()[1].data_points == 59


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, fitted, tmp_path, monkeypatch):
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    registry.record(fitted)
    before = registry.current()[1]
    with monkeypatch.context() as patch:
        patch.setattr(registry._runs.commits, "add", lambda *given, **named: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            registry.record(forecast.retrain(series(spark, 60), AS_OF))
    assert registry.current()[1] == before and registry.runs().count() == 1
