"""Quality of documents: base rules, and outliers by robust multivariate distance.

All statistics are columns of built-in functions; no text leaves the scan stage. The estimates
are minimum-covariance-determinant ones per language and source. Each starts from the rows near
the median of every statistic and then takes concentration steps: mean and covariance of the
``share`` of rows that lie nearest by the last estimate. Rows are ordered by bins of their
distance, so a step is a pre-aggregated count and a pre-aggregated sum of moments, whatever
the size of a group, and gives the same subset however the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.llm.storage import stored

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW_WORDS = 5
SHARE = 0.75
STEPS = 4
# Squared distance, in units in which the median row of a group has the median of a chi-square
# variable with as many degrees of freedom as there are statistics (fixed value).
CUTOFF = 75.0
CHI_SQUARE_MEDIAN = 4.351
# Smallest standard deviation that a statistic is taken to have, and the weight, in rows, with
# which it enters a group's covariance. A group of few rows is judged by these.
STATISTICS = {
    "x_length": 0.08,
    "x_symbols": 0.2,
    "x_lines": 0.12,
    "x_repeats": 0.12,
    "x_capitals": 0.06,
}
FLOOR_ROWS = 20

JUDGEMENT = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "distance",
    "kept",
]

SPACES = "\t\n\x0b\x0c\r "
_NAMES = list(STATISTICS)
_GROUP = ["g_lang", "g_source"]


def text_statistics(documents: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines``,
    ``n_capitals``, read from the whole ``text`` (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    solid = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents.withColumns(
        {
            "_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""),
            "_lines": lines,
            "word_chars": F.length(solid).cast("long"),
            "n_symbols": _stripped(text, "#*$%&|<>"),
            "n_capitals": _stripped(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        }
    )
    n_windows = F.size("_words") - (WINDOW_WORDS - 1)
    starts = F.when(n_windows > 0, F.slice("_words", 1, n_windows))
    window_code = F.transform(
        starts,
        lambda word, at: F.xxhash64(
            word, *(F.get("_words", at + step) for step in range(1, WINDOW_WORDS))
        ),
    )
    coded = counted.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_codes": window_code,
        }
    ).drop("_words", "_lines")
    repeats = F.size(F.array_distinct("_codes")) < F.size("_codes")
    placed = F.sort_array(
        F.transform("_codes", lambda code, at: F.struct(code.alias("code"), at.alias("at")))
    )
    sorted_codes = coded.withColumn("_placed", F.when(repeats, placed)).drop("_codes")
    found = F.filter(
        "_placed",
        lambda own, k: F.coalesce(own["code"] == F.get("_placed", k - 1)["code"], F.lit(False))
        | F.coalesce(own["code"] == F.get("_placed", k + 1)["code"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(found, lambda own: own["at"])),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("last")),
        lambda done, at: F.struct(
            (done["n"] + F.least(F.lit(WINDOW_WORDS), at - done["last"])).alias("n"),
            at.alias("last"),
        ),
        lambda done: done["n"],
    )
    return sorted_codes.withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")
    ).drop("_placed")


def _stripped(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def judged(
    documents: DataFrame,
    carry: list[str] | None = None,
    share: float = SHARE,
    steps: int = STEPS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """``documents`` with the columns of ``JUDGEMENT``, from ``text``, ``lang``, ``source``.

    ``distance`` is the squared robust distance from the language and source of the document;
    null languages or sources form a group of their own. ``kept`` is false if the base rules
    fail or the distance exceeds ``cutoff``; a group of which no row passes the base rules has
    no distance. Rows that fail the base rules do not enter the estimates. Of the input's
    columns those in ``carry`` are returned, else all; any that have a name of ``JUDGEMENT``
    are replaced. Every row of the input gives one row.
    """
    carried = [c for c in (documents.columns if carry is None else carry) if c not in JUDGEMENT]
    packed = documents.select(F.struct(*carried).alias("row"), "text", "lang", "source")
    facts = text_statistics(packed).withColumn("base_failed", base_failed()).drop("text")
    n_words, chars = F.col("n_words"), F.col("word_chars")
    vectors = facts.withColumns(
        {
            "g_lang": F.coalesce(F.col("lang"), F.lit("")),
            "g_source": F.coalesce(F.col("source"), F.lit("")),
            "x_length": F.log((chars + 300) / (n_words + 50)),
            "x_symbols": F.log1p(100 * F.col("n_symbols") / (chars + 200)),
            "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / (n_words + 50)),
            "x_capitals": F.sqrt(F.col("n_capitals") / (chars + 100)),
        }
    )
    rows = stored(vectors, "statistics")
    narrow = rows.where("NOT base_failed").select(*_GROUP, *_NAMES)
    estimate = _start(narrow, share)
    for _ in range(steps):
        estimate = stored(_concentrated(narrow, estimate, share), "estimate")
    scaled = _scaled(narrow, estimate)
    distance = rows.join(scaled, _GROUP, "left").withColumn(
        "distance", _distance() / F.col("unit")
    )
    inside = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    kept = distance.withColumn("kept", ~F.col("base_failed") & inside)
    return kept.select(*(F.col("row")[c].alias(c) for c in carried), *JUDGEMENT)


def _binned(value: Column) -> Column:
    """Bins of a sixteenth of a doubling."""
    return F.floor(16 * F.log2(value + 2.0**-20))


def _reached(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``keys, reached``: the first ``bin`` of each group at which ``share`` of its rows is met.
    The window runs over the counted bins, a bounded number in each group."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    return (
        counts.withColumn("upto", F.sum("n").over(along))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("upto") >= share * F.col("all"))
        .groupBy(*keys)
        .agg(F.min("bin").alias("reached"))
    )


def _start(rows: DataFrame, share: float) -> DataFrame:
    """Medians as centre, the floors as spread."""
    long = rows.select(
        *_GROUP,
        F.explode(
            F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in _NAMES))
        ).alias("item"),
    ).select(*_GROUP, "item.name", F.floor(F.col("item.value") * 64).alias("bin"))
    medians = (
        _reached(long, [*_GROUP, "name"], 0.5)
        .groupBy(*_GROUP)
        .pivot("name", _NAMES)
        .agg(F.first((F.col("reached") + 0.5) / 64))
    )
    columns = [F.col(x).alias(f"m_{i}") for i, x in enumerate(_NAMES)]
    spread = [
        (F.lit(1.0 / STATISTICS[x]) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}")
        for i, x in enumerate(_NAMES)
        for j in range(i + 1)
    ]
    return stored(medians.select(*_GROUP, *columns, *spread), "estimate")


def _distance() -> Column:
    """Squared length of the vector after the inverse Cholesky factor ``w`` of its group."""
    away = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(_NAMES)]
    total = F.lit(0.0)
    for i in range(len(_NAMES)):
        turned = sum((F.col(f"w_{i}_{j}") * away[j] for j in range(i + 1)), F.lit(0.0))
        total = total + turned * turned
    return total


def _concentrated(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """Mean and inverse Cholesky factor of the rows nearest by ``estimate``."""
    near = rows.join(estimate, _GROUP).withColumn("bin", _binned(_distance()))
    # Written, one row a group: a group may hold a third of all rows that it is joined to.
    limit = stored(_reached(near, _GROUP, share), "limits")
    away = {i: F.col(x) - F.col(f"m_{i}") for i, x in enumerate(_NAMES)}
    moments = (
        near.join(limit, _GROUP)
        .where("bin <= reached")
        .groupBy(*_GROUP, *(f"m_{i}" for i in away))
        .agg(
            F.count("*").alias("n"),
            *(F.avg(away[i]).alias(f"a_{i}") for i in away),
            *(F.avg(away[i] * away[j]).alias(f"p_{i}_{j}") for i in away for j in range(i + 1)),
        )
    )
    lower = moments.select(
        *_GROUP,
        *((F.col(f"m_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in away),
        *(
            (
                (
                    F.col("n") * (F.col(f"p_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}"))
                    + (FLOOR_ROWS * STATISTICS[x] ** 2 if i == j else 0.0)
                )
                / (F.col("n") + FLOOR_ROWS)
                + (STATISTICS[x] ** 2 / 4 if i == j else 0.0)
            ).alias(f"c_{i}_{j}")
            for i, x in enumerate(_NAMES)
            for j in range(i + 1)
        ),
    )
    # Cholesky factor l of the covariance, one column after the other, then its inverse w.
    for j in range(len(_NAMES)):
        left = F.col(f"c_{j}_{j}") - sum(
            (F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0)
        )
        lower = lower.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        lower = lower.withColumns(
            {
                f"l_{i}_{j}": (
                    F.col(f"c_{i}_{j}")
                    - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
                )
                / F.col(f"l_{j}_{j}")
                for i in range(j + 1, len(_NAMES))
            }
        ) if j + 1 < len(_NAMES) else lower
    for i in range(len(_NAMES)):
        lower = lower.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        for j in range(i - 1, -1, -1):
            mixed = sum(
                (F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)
            )
            lower = lower.withColumn(f"w_{i}_{j}", -mixed / F.col(f"l_{i}_{i}"))
    return lower.select(
        *_GROUP,
        *(f"m_{i}" for i in away),
        *(f"w_{i}_{j}" for i in away for j in range(i + 1)),
    )


def _scaled(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate with the ``unit`` that gives a group's median row the expected distance.
    A unit is at least 1, so that statistics that hardly vary are not stretched."""
    binned = rows.join(estimate, _GROUP).withColumn("bin", _binned(_distance()))
    middle = stored(_reached(binned, _GROUP, 0.5), "middles")
    unit = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("reached") / 16) / CHI_SQUARE_MEDIAN)
    return stored(estimate.join(middle.select(*_GROUP, unit.alias("unit")), _GROUP), "units")
