"""Stored models and the runs that made them."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.operators.forecast import Training
from skyvane.sources.committed import CommittedTable


class ModelRegistry:
    """Every training run in the order of commits, with where its model is, if it made one.

    A model is stored before its run is committed, and the current model is that of the newest
    run that has one, so a commit changes model, record and status at once, and a run that fails
    or made no model changes none of them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._models = spark, f"{folder}/models"
        self._runs = CommittedTable(spark, f"{folder}/runs", f"{schemas.TRAINING_RUNS}, model STRING")

    def record(self, training: Training, key: str | None = None) -> bool:
        """Store the run and its model, if any; False, and no change, if the run ``key`` is in."""
        key = key or uuid.uuid4().hex
        if self._runs.commits.has(key):
            return False
        model = None
        if training.model is not None and training.is_new:
            model = f"{self._models}/{uuid.uuid4().hex}"
            training.model.write().save(model)
        return self._runs.append(training.run.withColumn("model", F.lit(model).cast("string")), key)

    def runs(self) -> DataFrame:
        """All runs, by the number of their ``commit``."""
        return self._runs.rows(numbered="commit")

    def current_run(self) -> DataFrame:
        """The record of the current model, or no row."""
        return self.runs().where("model IS NOT NULL").orderBy(F.desc("commit")).limit(1)

    def current(self) -> tuple[PipelineModel, Row] | None:
        """The current model and its record."""
        run = self.current_run().first()
        return run and (PipelineModel.load(run.model), run)

    def is_trained(self) -> DataFrame:
        """One row that says whether there is a model."""
        return self.runs().agg((F.count("model") > 0).alias("is_trained"))
