"""Predictions of a stored tree model without the library that fitted it.

The stored nodes are read as a table, and rows descend them a batch at a time: the scaled features
of each row are compared with the threshold of the node it is at until it stands on a leaf.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = -1


def _metadata(spark: SparkSession, folder: str) -> dict:
    (line,) = spark.read.text(f"{folder}/metadata").first()
    return json.loads(line)


def _stages(spark: SparkSession, folder: str) -> list[str]:
    uids = _metadata(spark, folder)["paramMap"]["stageUids"]
    digits = len(str(len(uids)))
    return [f"{folder}/stages/{place:0{digits}d}_{uid}" for place, uid in enumerate(uids)]


def node_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per node of the stored pipeline's trees: ``tree, weight, node, feature, threshold,
    left, right, prediction``; at a leaf ``left`` and ``right`` are -1."""
    stage = _stages(spark, folder)[-1]
    weights = spark.read.parquet(f"{stage}/treesMetadata").toDF("tree", "metadata", "weight")
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("prediction"),
    )
    return nodes.join(weights.select("tree", "weight"), "tree")


def _scaling(spark: SparkSession, folder: str) -> tuple[list[float], list[float]]:
    """What is taken off each feature, and what it is then multiplied by."""
    row = spark.read.parquet(f"{_stages(spark, folder)[1]}/data").first()
    return list(row.mean), [1 / std if std else 0.0 for std in row.std]


@dataclass(frozen=True)
class Tree:
    """Nodes by their number; a leaf is its own child, so that a row which is there stays."""

    weight: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray

    def values(self, features: list[np.ndarray], depth: int) -> np.ndarray:
        """The prediction for each row of the columns ``features``."""
        table, row = np.stack(features), np.arange(len(features[0]))
        at = np.zeros(len(row), dtype=np.int32)
        for _ in range(depth):
            goes_left = table[self.feature[at], row] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.prediction[at]


def _trees(spark: SparkSession, folder: str) -> list[Tree]:
    nodes = node_table(spark, folder).orderBy("tree", "node").toArrow()
    column = {name: nodes[name].to_numpy() for name in nodes.column_names}
    begins = np.flatnonzero(np.diff(column["tree"], prepend=-1))
    trees = []
    for begin, stop in zip(begins, [*begins[1:], len(nodes)]):
        own = {name: values[begin:stop] for name, values in column.items()}
        here, is_leaf = np.arange(stop - begin, dtype=np.int32), own["left"] == LEAF
        trees.append(
            Tree(
                float(own["weight"][0]),
                np.where(is_leaf, 0, own["feature"]),
                np.where(is_leaf, 0.0, own["threshold"]),
                np.where(is_leaf, here, own["left"]),
                np.where(is_leaf, here, own["right"]),
                own["prediction"],
            )
        )
    return trees


def predicted(
    spark: SparkSession, folder: str, rows: DataFrame, features: list[str], name: str = "prediction"
) -> DataFrame:
    """``rows`` with the prediction of the pipeline stored in ``folder``. A missing feature is
    no number and goes right, as in the library. The trees are broadcast, as large as the stored
    nodes, whose number the depth and the number of trees bound."""
    trees = spark.sparkContext.broadcast(_trees(spark, folder))
    is_sum = "GBT" in _metadata(spark, _stages(spark, folder)[-1])["class"]
    means, scales = _scaling(spark, folder)
    known = [F.coalesce(F.col(feature).cast("double"), F.lit(float("nan"))) for feature in features]
    scaled = [(x - mean) * scale for x, mean, scale in zip(known, means, scales)]
    depth = _depth(spark, folder)

    @F.arrow_udf("double")
    def descended(*columns: pa.Array) -> pa.Array:
        held = [column.to_numpy(zero_copy_only=False) for column in columns]
        total = np.zeros(len(held[0]))
        for tree in trees.value:
            total += tree.weight * tree.values(held, depth)
        return pa.array(total if is_sum else total / len(trees.value))

    return rows.withColumn(name, descended(*scaled))


def _depth(spark: SparkSession, folder: str) -> int:
    return int(_metadata(spark, _stages(spark, folder)[-1])["paramMap"]["maxDepth"])
