"""Prediction of the next reading's temperature at a location.

The target is the next row in time order, not a fixed hour ahead; the shown time of a
prediction is nevertheless one hour after the reading, as users of the service expect it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.functions import numbers, times
from skyvane.operators import lookups
from skyvane.operators.aggregates import regression_metrics
from skyvane.operators.windows import with_next
from skyvane.session import checkpointed

FEATURES = [
    "temperature",
    "humidity",
    "pressure_scaled",
    "wind_speed",
    "hour",
    "day_of_week",
    "month",
]

# Size of the forest, seed, training window.
TREES = 50
DEPTH = 10
SEED = 42
TRAINING_HOURS = 168
# Parts of the training rows. In each pass over them every part gives sums for all nodes of a
# level, hundreds of MB at the deepest, so their number is fixed and not that of the shuffle.
PARTS = 24


def with_features(readings: DataFrame) -> DataFrame:
    ts = F.col("recorded_at")
    return readings.withColumns(
        {
            "pressure_scaled": numbers.hectopascal_scaled(F.col("pressure")),
            "hour": times.hour_of(ts),
            "day_of_week": times.weekday_from_sunday(ts),
            "month": times.month_of(ts),
        }
    )


def training_pairs(
    readings: DataFrame, steps: int = 1, target: str = "temperature"
) -> DataFrame:
    """Features of each reading with ``target`` of the reading ``steps`` rows later at the
    same location. Readings without such a successor, or with a null target, are left out."""
    needed = list(
        dict.fromkeys(
            [
                "data_id",
                "location",
                "recorded_at",
                "temperature",
                "humidity",
                "pressure",
                "wind_speed",
                target,
            ]
        )
    )
    followed = with_next(readings.select(*needed), "location", [target], steps=steps)
    return (
        with_features(followed)
        .where(F.col("next").isNotNull())
        .withColumn("target", F.col(f"next.{target}"))
        .where(F.col("target").isNotNull())
        .select("data_id", "location", "recorded_at", *FEATURES, "target")
    )


def is_test_row(row_id: Column) -> Column:
    """About one row in five, the same ones on every run and in every partitioning."""
    digits = F.substring(F.md5(row_id.cast("string")), 1, 6)
    return F.conv(digits, 16, 10).cast("bigint") % 5 == 0


def complete(columns: list[str]) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull()
    return condition


def forest(features: list[str]) -> Pipeline:
    return _pipeline(
        features,
        RandomForestRegressor(
            featuresCol="scaled",
            labelCol="target",
            predictionCol="prediction",
            numTrees=TREES,
            maxDepth=DEPTH,
            maxBins=64,
            seed=SEED,
            featureSubsetStrategy="all",
        ),
    )


def boosted_trees(features: list[str]) -> Pipeline:
    return _pipeline(
        features,
        GBTRegressor(
            featuresCol="scaled",
            labelCol="target",
            predictionCol="prediction",
            maxIter=10,
            maxDepth=5,
            seed=SEED,
        ),
    )


def _pipeline(features: list[str], regressor) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[assembler, scaler, regressor])


@dataclass(frozen=True)
class Training:
    """A fitted model with its one-row run record, or a record of why there is none."""

    model: PipelineModel | None
    run: DataFrame
    score: float | None
    is_new: bool = True


def train(
    pairs: DataFrame,
    trained_at: str,
    name: str,
    features: list[str] | None = None,
    pipeline: Pipeline | None = None,
    minimum: int = lookups.MINIMUM_HISTORY,
    parts: int = PARTS,
) -> Training:
    """Fit on four fifths of the pairs and score on the rest.

    The pairs are kept in memory and on disk while the forest passes over them. ``parts`` says
    into how many parts at most they are put together; the trees are drawn part by part, so
    another number gives another forest. It never follows a count.
    """
    features = features or FEATURES
    spark = pairs.sparkSession
    usable = pairs.where(complete(features)).withColumn(
        "is_test", is_test_row(F.col("data_id"))
    ).persist()
    try:
        n_pairs, n_test = usable.agg(F.count("*"), F.count_if("is_test")).first()
        if n_pairs < minimum - 1:
            record = (None, name, n_pairs, 0, None, None, None, "too little data")
            return Training(None, _run_record(spark, record, trained_at), None)
        dealt = usable.coalesce(parts)
        model = (pipeline or forest(features)).fit(dealt.where(~F.col("is_test")))
        metrics = regression_metrics(
            model.transform(dealt.where("is_test")), "target", "prediction"
        ).first()
        score = None if metrics.r2 is None else round(metrics.r2, 3)
        record = (None, name, n_pairs, n_pairs - n_test, score, metrics.mae, metrics.rmse, "trained")
        return Training(model, _run_record(spark, record, trained_at), metrics.r2)
    finally:
        usable.unpersist()


def _run_record(spark, record: tuple, trained_at: str) -> DataFrame:
    row = spark.createDataFrame([record], schemas.TRAINING_RUNS)
    return row.withColumn("trained_at", F.lit(trained_at).cast("timestamp"))


def retrain(
    readings: DataFrame,
    as_of: str,
    locations: list[str] | None = None,
    hours: int = TRAINING_HOURS,
) -> Training:
    """Train on the last ``hours`` of the given locations, or of all of them, where there is
    enough history."""
    recent = lookups.since(readings, as_of, hours)
    if locations is not None:
        recent = recent.where(F.col("location").isin(locations))
    pairs = training_pairs(lookups.with_enough_history(recent))
    return train(pairs, as_of, ",".join(locations) if locations else "all")


def ensure_trained(
    model: PipelineModel | None, readings: DataFrame, as_of: str, locations: list[str] | None = None
) -> Training:
    """Train only when there is no model yet; the run record says which it was."""
    if model is None:
        return retrain(readings, as_of, locations)
    record = (None, ",".join(locations) if locations else "all", 0, 0, None, None, None, "already trained")
    run = _run_record(readings.sparkSession, record, as_of)
    return Training(model, run, None, is_new=False)


def predict(model: PipelineModel, readings: DataFrame, score: float | None) -> DataFrame:
    """Add the predicted temperature, its confidence and its time to readings.

    The confidence is the hold-out R² of the model, clamped, and not a measure of a single
    row. A reading with a missing feature gets no prediction.
    """
    names = readings.columns
    known = complete(FEATURES)
    scored = model.transform(with_features(readings))
    return scored.select(
        *names,
        F.when(known, numbers.round_half_even(F.col("prediction"), 1)).alias(
            "predicted_temperature"
        ),
        F.when(known, numbers.clamp_confidence(F.lit(score).cast("double"))).alias("confidence"),
        F.when(known, times.plus_hours(F.col("recorded_at"), 1)).alias("predicted_for"),
    )


def saved_model(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def loaded_model(spark, folder: str) -> PipelineModel | None:
    """The stored model, or None where none was stored yet."""
    try:
        found = not spark.read.text(f"{folder}/metadata").isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = False
    return PipelineModel.load(folder) if found else None


def append_run(run: DataFrame, folder: str) -> None:
    run.write.mode("append").parquet(folder)


def status_panel(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest score and training time per trained set, and how many predictions were made."""
    latest = runs.where(F.col("status") == "trained").groupBy("locations").agg(
        F.max("trained_at").alias("last_training"),
        F.max_by("data_points", "trained_at").alias("data_points"),
        F.max_by("score", "trained_at").alias("score"),
    )
    made = predictions.agg(F.count("predicted_temperature")).scalar()
    return latest.withColumn("predictions_made", made)


# Declared extensions -------------------------------------------------------------------

def location_models(
    pairs: DataFrame, features: list[str] | None = None, minimum: int = lookups.MINIMUM_HISTORY - 1
) -> DataFrame:
    """A linear model for every location, by least squares: ``location, n, status, intercept,
    coefficients``, the latter in the order of ``features``.

    One aggregate takes the means and the products about them, whatever the number of locations
    and rows, and the few equations of a location are solved in its row. A feature that is
    constant at a location, or follows from those before it, has the coefficient 0. A location
    with fewer than ``minimum`` complete pairs has no model, and its status says so.
    """
    features = features or FEATURES
    columns = [*features, "target"]
    usable = pairs.where(complete(columns))
    products = [
        F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}_{k}")
        for i, a in enumerate(columns)
        for k, b in enumerate(columns)
        if i <= k
    ]
    means = [F.avg(name).alias(f"_mean_{i}") for i, name in enumerate(columns)]
    sums = usable.groupBy("location").agg(F.count("*").alias("n"), *means, *products)
    last = len(features)
    spread = [F.sqrt(F.greatest(F.col(f"_{i}_{i}"), F.lit(0.0))) for i in range(last + 1)]
    correlated = F.array(
        *(
            F.coalesce(
                F.try_divide(F.col(f"_{min(i, k)}_{max(i, k)}"), spread[i] * spread[k]), F.lit(0.0)
            )
            for i in range(last + 1)
            for k in range(last + 1)
        )
    )
    solved = sums.withColumn("_solved", _solved(correlated, last))
    slopes = [
        F.coalesce(
            F.get("_solved", F.lit(i * (last + 1) + last)) * F.try_divide(spread[last], spread[i]),
            F.lit(0.0),
        )
        for i in range(last)
    ]
    fitted = solved.withColumn("_slopes", F.array(*slopes))
    at_means = sum(
        (F.get("_slopes", F.lit(i)) * F.col(f"_mean_{i}") for i in range(last)), F.lit(0.0)
    )
    enough = F.col("n") >= minimum
    return fitted.select(
        "location",
        "n",
        F.when(enough, "trained").otherwise("too little data").alias("status"),
        F.when(enough, F.col(f"_mean_{last}") - at_means).alias("intercept"),
        F.when(enough, F.col("_slopes")).alias("coefficients"),
    )


# The share of a feature's spread that others leave unexplained, below which it follows from them.
DEPENDENT = 1e-9


def _solved(matrix: Column, n: int) -> Column:
    """Sweep the ``n`` features of a matrix of ``n + 1`` columns, given row by row: its last
    column then holds their coefficients. What nothing is left of is set to zero."""
    width = n + 1

    def swept(held: Column, k: Column) -> Column:
        pivot = F.get(held, k * width + k)

        def entry(value: Column, place: Column) -> Column:
            row, column = F.floor(place / width).cast("int"), place % width
            across = F.get(held, row * width + k) * F.get(held, k * width + column)
            return (
                F.when(pivot <= DEPENDENT, F.when((row == k) | (column == k), 0.0).otherwise(value))
                .when((row == k) & (column == k), 1 / pivot)
                .when(row == k, value / pivot)
                .when(column == k, -value / pivot)
                .otherwise(value - across / pivot)
            )

        return F.transform(held, entry)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, swept)


def predict_by_location(
    models: DataFrame, rows: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """``rows`` with ``prediction`` by the model of their location; null without a model or a
    feature. ``models`` is best a written table: then a hot location of ``rows`` can be split."""
    features = features or FEATURES
    terms = (F.get("_slopes", F.lit(i)) * F.col(name) for i, name in enumerate(features))
    known = models.select(
        "location", F.col("intercept").alias("_intercept"), F.col("coefficients").alias("_slopes")
    )
    return (
        rows.join(known, "location", "left")
        .withColumn("prediction", sum(terms, F.col("_intercept")))
        .drop("_intercept", "_slopes")
    )


@dataclass(frozen=True)
class LocationTraining:
    """The models of all locations with the one-row record of the run."""

    models: DataFrame
    run: DataFrame
    score: float | None


def train_by_location(
    pairs: DataFrame, trained_at: str, name: str = "all, by location"
) -> LocationTraining:
    """Fit a model for every location on four fifths of its pairs and score them on the rest."""
    usable = checkpointed(
        pairs.where(complete(FEATURES)).withColumn("is_test", is_test_row(F.col("data_id")))
    )
    models = checkpointed(location_models(usable.where(~F.col("is_test"))))
    scored = predict_by_location(models, usable.where("is_test")).where("prediction IS NOT NULL")
    n_pairs, n_test = usable.agg(F.count("*"), F.count_if("is_test")).first()
    if models.where("intercept IS NOT NULL").isEmpty():
        record = (None, name, n_pairs, 0, None, None, None, "too little data")
        return LocationTraining(models, _run_record(pairs.sparkSession, record, trained_at), None)
    metrics = regression_metrics(scored, "target", "prediction").first()
    score = None if metrics.r2 is None else round(metrics.r2, 3)
    record = (None, name, n_pairs, n_pairs - n_test, score, metrics.mae, metrics.rmse, "trained")
    return LocationTraining(
        models, _run_record(pairs.sparkSession, record, trained_at), metrics.r2
    )


def persistence(pairs: DataFrame) -> DataFrame:
    """The forecast to beat: the next reading is like this one."""
    return pairs.withColumn("prediction", F.col("temperature"))


def ensemble(models: list[PipelineModel], rows: DataFrame) -> DataFrame:
    """Mean of the predictions of several fitted models."""
    names = rows.columns
    scored = rows
    for number, model in enumerate(models):
        scored = model.transform(scored).withColumnRenamed("prediction", f"_p{number}")
        scored = scored.drop("raw", "scaled")
    total = sum((F.col(f"_p{number}") for number in range(len(models))), F.lit(0.0))
    return scored.select(*names, (total / len(models)).alias("prediction"))
