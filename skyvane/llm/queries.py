"""Registered queries of the pipeline operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.llm import (
    chat_format,
    decontamination,
    importance_sampling,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    quality_rules,
    token_counts,
    url_filter,
    warc,
    whitening,
)
from skyvane.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return mixing.mixed(documents, carry=["doc_id", "source", "lang"])


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    kept_back = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(documents.where(~kept_back))
    return language_id.with_language(
        documents.select("doc_id", "text", kept_back.alias("held_out")), model
    ).drop("text")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document and benchmark passage found in it."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    matched = decontamination.with_matches(documents, _table(spark, folder, "benchmark"))
    return matched.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    kept_back = language_id.held_out("doc_id", 7, 2).alias("held_out")
    documents = _table(spark, folder, "documents").select("doc_id", "text", kept_back)
    learns = ~F.col("held_out") & F.col("doc_id").isNotNull()
    return lm_scoring.lm_scores(documents, learns, carry=("doc_id", "held_out"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_marks(_table(spark, folder, "documents"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, chat_format.LOSS_ROLE, said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.formatted(turns))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, folder, "pages"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.written(_table(spark, folder, "pages"))
    return warc.read(index, payloads=False).drop("url")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents"), carry=["doc_id"])


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = _table(spark, folder, "embeddings")
    return whitening.whitened(embeddings, whitening.fit(embeddings))


def op12_importance_sampling(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = (_table(spark, folder, name) for name in ("documents", "benchmark"))
    return importance_sampling.resampled(documents, benchmark).drop("n_words")


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tokenizer's file is looked up where the driver runs; executors get its content."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_near_dedup,
        op2_mixing,
        op3_language_id,
        op4_decontamination,
        op5_lm_scoring,
        op6_license_scan,
        op7_chat_format,
        op8_url_filter,
        op9_warc,
        op10_quality_rules,
        op11_whitening,
        op12_importance_sampling,
        op13_token_counts,
    )
}
