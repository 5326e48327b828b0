"""Mixing documents to target shares of tokens by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked: scaled to the target shares of
topics, then of languages, then of sources, again and again until nothing moves. A cell's
calibrated weight is what it should hold of the mix; a document is drawn with the probability that
gives its cell that many tokens. A cell cannot give more than all of its documents: in each
scaling such cells are taken whole and the others of the same value make up for them. Sources
and languages come last, so their shares hold wherever the documents allow it, and topics give
way; ``shares`` shows what was met. Drawing compares the probability with a hash of the id, so it
gives the same documents however often and wherever it runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.llm.storage import stored

DIMENSIONS = ("topic", "lang", "source")
# Without given shares a dimension's target is its observed shares to this power, rescaled.
FLATTEN = 0.7
KEEP = 0.5
# The share of the mix that a round may still move when the raking is settled; rounds it may take.
SETTLED = 1e-4
ROUNDS = 100
SEED = "mix"
NOTHING = "(none)"


def topic(text: Column) -> Column:
    """The form of a text: ``tabular`` (a cell mark in 40 characters or fewer), ``brief`` (under
    500 characters), ``long`` (over 5000), else ``prose``. Null text is brief."""
    n = F.coalesce(F.length(text), F.lit(0))
    marks = n - F.coalesce(F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0))
    return (
        F.when((n > 0) & (marks * 40 >= n), "tabular")
        .when(n < 500, "brief")
        .when(n > 5000, "long")
        .otherwise("prose")
    )


def mixed(
    documents: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    flatten: float = FLATTEN,
    seed: str = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """``documents`` with ``topic, tokens, probability, weight, selected`` per row.

    ``targets`` may name shares per value of ``source``, ``lang`` or ``topic``; values that it
    does not name share what is left in proportion to their tokens. ``keep`` is the share of all
    tokens in the mix. ``weight`` is what a drawn document counts for (the reciprocal of its
    probability) and null for one that is not drawn. Null sources and languages are a value of
    their own; a text without words has no tokens and is drawn as its cell is, a cell without
    tokens never. Repeated rows are drawn alike; a row without doc_id is drawn by its text. Of
    the input's columns those in ``carry`` are returned, else all; any named like an added one
    are replaced. Raises RuntimeError if the raking does not settle within ``rounds``.
    """
    added = ["topic", "tokens", "probability", "weight", "selected"]
    carried = [c for c in (documents.columns if carry is None else carry) if c not in added]
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit(""))
    rows = documents.select(
        F.struct(*carried).alias("row"),
        F.coalesce("source", F.lit(NOTHING)).alias("source"),
        F.coalesce("lang", F.lit(NOTHING)).alias("lang"),
        topic(F.col("text")).alias("topic"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        .cast("long")
        .alias("tokens"),
        drawn(key, seed).alias("drawn"),
    )
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = stored(calibrated(cells, targets or {}, keep, rounds, flatten), "mix")
    return (
        rows.join(wanted.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
        .withColumn("selected", F.col("drawn") < F.col("probability"))
        .select(
            *(F.col("row")[c].alias(c) for c in carried),
            "topic",
            "tokens",
            "probability",
            F.when(F.col("selected"), 1 / F.col("probability")).alias("weight"),
            "selected",
        )
    )


def drawn(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 that depends on ``key`` and ``seed`` alone: 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def calibrated(
    cells: DataFrame,
    targets: dict[str, dict[str, float]],
    keep: float,
    rounds: int,
    flatten: float,
) -> DataFrame:
    """The dimensions, ``tokens``, ``probability`` and target shares of each of the ``cells``."""
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).first()[0]
    own = F.col("tokens") / F.lit(total)
    fitted = cells.where("tokens > 0").withColumns({"mass": own, "most": own / keep})
    for name in DIMENSIONS:
        share = _target(cells, name, targets.get(name), total, flatten)
        fitted = fitted.join(share.withColumnRenamed("share", f"{name}_share"), name)
    fitted = stored(fitted, "fitted")
    for _ in range(rounds):
        fitted = stored(_raked(fitted.withColumn("before", F.col("mass"))), "fitted")
        moved = fitted.agg(F.sum(F.abs(F.col("mass") - F.col("before")))).first()[0]
        if moved is None or moved <= SETTLED:
            break
    else:
        raise RuntimeError(f"the shares did not settle in {rounds} rounds")
    known = fitted.select(
        *DIMENSIONS,
        F.least(F.lit(1.0), F.col("mass") / F.col("most")).alias("probability"),
        *(f"{name}_share" for name in DIMENSIONS),
    )
    return cells.join(known, list(DIMENSIONS), "left").withColumn(
        "probability", F.coalesce("probability", F.lit(0.0))
    )


def _raked(fitted: DataFrame) -> DataFrame:
    """One round: masses scaled to the shares of topics, languages and sources in turn.

    What lacks something grows by its cells that are not taken whole. A value may hold most
    cells; its sums are pre-aggregated and joined.
    """
    columns = fitted.columns
    full = F.col("mass") >= F.col("most") * (1 - 1e-12)
    for name in DIMENSIONS:
        sums = fitted.groupBy(name).agg(
            F.sum("mass").alias("held"), F.sum(F.when(full, F.col("mass")).otherwise(0.0)).alias("whole")
        )
        share = F.col(f"{name}_share")
        less = F.col("mass") * share / F.col("held")
        more = F.col("mass") * F.try_divide(share - F.col("whole"), F.col("held") - F.col("whole"))
        scaled = (
            F.when(share <= F.col("held"), less).when(full, F.col("mass")).otherwise(more)
        )
        mass = F.least(F.col("most"), F.coalesce(scaled, F.col("mass")))
        fitted = fitted.join(sums, name).withColumn("mass", mass).select(*columns)
    return fitted


def shares(wanted: DataFrame) -> DataFrame:
    """``dimension, value, target, expected``: the share of the mix's tokens that each source,
    language and topic was to have and that it gets, from the table that ``calibrated`` gives.
    What cannot be met is where the two differ."""
    tokens = F.col("tokens") * F.col("probability")
    whole = wanted.agg(F.sum(tokens)).scalar()
    parts = [
        wanted.where("tokens > 0")
        .groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value"))
        .agg(F.max(f"{name}_share").alias("target"), (F.sum(tokens) / whole).alias("expected"))
        for name in DIMENSIONS
    ]
    return reduce(DataFrame.unionByName, parts)


def _target(
    cells: DataFrame, name: str, given: dict[str, float] | None, total: float, flatten: float
) -> DataFrame:
    """``name, share`` for each value with tokens; the shares sum to 1."""
    held = cells.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0")
    if given is None:
        raised = held.withColumn("part", F.pow(F.col("n") / F.lit(total), F.lit(flatten)))
    else:
        named = held.sparkSession.createDataFrame(
            [(value, float(share)) for value, share in given.items()], f"{name} string, given double"
        )
        both = held.join(named, name, "left")
        left = max(0.0, 1.0 - sum(given.values()))
        unnamed = both.agg(F.sum(F.when(F.col("given").isNull(), F.col("n")))).first()[0] or 1
        raised = both.withColumn(
            "part", F.coalesce("given", F.col("n") * F.lit(left / unnamed))
        ).where("part > 0")
    whole = raised.agg(F.sum("part")).first()[0] or 1.0
    return raised.select(name, (F.col("part") / F.lit(whole)).alias("share"))
