"""From raw documents to a training mix: five stages, each written before the next one reads.

A stage takes ``(spark, docs, sf_dir)`` and returns the rows of ``docs`` that it keeps, with
the columns of ``docs``; the last one adds ``weight``, what a drawn document counts for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyvane.llm import decontamination, language_id, mixing, near_dedup, quality_rules
from skyvane.llm.storage import stored

# Belief in the predicted language below which a document has no language to speak of.
LEAST_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: some letter, and a prediction that is not a guess."""
    packed = docs.select(F.struct("*").alias("document"), "text")
    predicted = language_id.with_language(packed, language_id.fit(docs))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return predicted.where(known).select("document.*")


def well_formed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    packed = docs.select(F.struct("*").alias("document"), "text", "lang", "source")
    return quality_rules.judged(packed, carry=["document"]).where("kept").select("document.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Of rows with one doc_id that with the
    smallest text stays; rows without doc_id stay."""
    found = near_dedup.near_duplicates(docs)
    keep = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    packed = docs.select("doc_id", "text", F.struct("*").alias("document"))
    first = Window.partitionBy("doc_id").orderBy("text")
    one = packed.join(keep, "doc_id", "left_semi").withColumn("place", F.row_number().over(first))
    rest = packed.where("doc_id IS NULL")
    return one.where("place = 1").unionByName(rest, allowMissingColumns=True).select("document.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed = docs.select("doc_id", "text", F.struct("*").alias("document"))
    matched = decontamination.with_matches(packed, benchmark)
    return matched.where(F.size("matches") == 0).select("document.*")


def sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target shares, with their weight."""
    packed = docs.select(F.struct("*").alias("document"), "doc_id", "text", "lang", "source")
    drawn = mixing.mixed(packed, carry=["document"]).where("selected")
    own = [name for name in docs.columns if name.lower() != "weight"]
    others = [F.col("document")[name].alias(name) for name in own]
    return drawn.select(*others, "weight")


STAGES = [
    ("language_id", identified),
    ("quality_rules", well_formed),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", sampled),
]

# Fitted language models, latent spaces and robust estimates have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
