"""License marks in documents: exact phrases, and blocks of text that contain a template.

A block is a line. It meets a template if it has at least ``threshold`` of the template's
distinct words. All such pairs are found by an exact set-similarity join:

* Words are ordered by how many blocks of the corpus have them, rarest first.
* A template that must share ``need`` of its ``size`` words is looked up by its ``size - need
  + 1`` rarest words only: a block without any of these cannot share enough (prefix filter).
* A block with fewer than ``need`` words of any template is left out (length filter).
* At the first shared word, what remains of the block and of the template bounds the words
  that can still be shared (positional filter). The pairs left are counted in full.

Only words that occur in templates take part, and the templates are a parameter of the caller,
so the lookup tables are as small as that parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that are looked for word by word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that a line may contain, with some words changed, and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("reserved", "all rights reserved"),
    ("public-domain", "this work is dedicated to the public domain"),
]
THRESHOLD = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What lies between words. Upper-case letters are gone by then.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_marks(
    documents: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z lower-cased; null
    text is empty. ``n_base`` counts the places of all ``phrases``, ``first_word`` and
    ``last_word`` are their smallest and largest start. ``labels`` adds those of templates met
    by a line; ``score`` is the largest share of a template found in a line that meets it, and
    1 where a phrase was found. Rows with equal ids and texts get equal results; other columns
    are ignored.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    texts = documents.select("doc_id", lowered.alias("text"))
    keyed = texts.withColumn("content", F.xxhash64("text"))
    found = _phrases(keyed, phrases).alias("p")
    met = _met_templates(keyed, templates, threshold).alias("t")
    same = F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (
        F.col("p.content") == F.col("t.content")
    )
    more = F.coalesce("t.more", F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", more)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return found.join(met, same, "left").select(
        F.col("p.doc_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def _word_array(text: Column | str) -> Column:
    return F.array_remove(F.split(text, _BETWEEN, -1), "")


def _phrases(texts: DataFrame, phrases: dict[str, str]) -> DataFrame:
    # Every word gets a blank of its own on either side, so that neighbours do not share one.
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace("text", _BETWEEN, "  ")), F.lit(" "))
    spaced = texts.select("doc_id", "content", flat.alias("flat"))
    n_words = F.when(F.col("flat") == "  ", 0).otherwise(_blanks(F.col("flat")) / 2)
    counted = spaced.withColumn("n_words", n_words.cast("long"))
    places, first, last, labels = [], [], [], []
    for phrase, label in phrases.items():
        spelled = "".join(f" {word} " for word in phrase.split())
        has = F.col("flat").contains(spelled)
        n = len(phrase.split())
        before = F.expr(f"substring(flat, 1, locate('{spelled}', flat) - 1)")
        after = F.expr(
            f"substring(reverse(flat), 1, locate('{spelled[::-1]}', reverse(flat)) - 1)"
        )
        places.append(F.when(has, F.regexp_count("flat", F.lit(f"(?={spelled})"))).otherwise(0))
        first.append(F.when(has, _blanks(before) / 2))
        last.append(F.when(has, F.col("n_words") - _blanks(after) / 2 - n))
        labels.append(F.when(has, F.lit(label)))
    return counted.select(
        "doc_id",
        "content",
        "n_words",
        sum(places, F.lit(0)).cast("long").alias("n_base"),
        F.least(*first, F.lit(None)).cast("long").alias("first_word"),
        F.greatest(*last, F.lit(None)).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _met_templates(
    texts: DataFrame, templates: list[tuple[str, str]], threshold: float
) -> DataFrame:
    """``doc_id, content, more, best``: labels and best share of templates met by a line."""
    spark = texts.sparkSession
    word_sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({word for _, words in word_sets for word in words})
    held = F.array_intersect(_word_array("text"), F.array(*map(F.lit, vocabulary)))
    frequency = {
        row.word: row.n  # as many rows at most as the templates have words
        for row in texts.select(F.explode(held).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    order = sorted(vocabulary, key=lambda word: (frequency.get(word, 0), word))
    rank = {word: place for place, word in enumerate(order, 1)}
    lookup, least_need = [], len(order)
    for template, (label, words) in enumerate(word_sets):
        ranks = sorted(rank[word] for word in words)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        least_need = min(least_need, need)
        for place, of_word in enumerate(ranks[: len(ranks) - need + 1]):
            lookup.append((of_word, template, label, place, need, ranks))
    prefixes = spark.createDataFrame(
        lookup,
        "rank int, template int, label string, place int, need int, ranks array<int>",
    )
    rare = sorted({order[row[0] - 1] for row in lookup})
    in_order = F.array(*map(F.lit, order))
    blocks = (
        texts.where(F.arrays_overlap(_word_array("text"), F.array(*map(F.lit, rare))))
        .select("doc_id", "content", F.posexplode(F.split("text", "\n", -1)).alias("block", "line"))
        .withColumn("shared", F.array_intersect(_word_array("line"), in_order))
        .where(F.size("shared") >= least_need)
        .withColumn(
            "owned",
            F.sort_array(
                F.transform("shared", lambda word: F.array_position(in_order, word).cast("int"))
            ),
        )
        .select("doc_id", "content", "block", "owned")
    )
    candidates = (
        blocks.select("*", F.posexplode("owned").alias("at", "rank"))
        .join(F.broadcast(prefixes), "rank")
        .where(
            F.least("at", "place")
            + 1
            + F.least(F.size("owned") - F.col("at"), F.size("ranks") - F.col("place"))
            - 1
            >= F.col("need")
        )
    )
    both = F.size(F.array_intersect("owned", "ranks"))
    return (
        candidates.where(both >= F.col("need"))
        .groupBy("doc_id", "content")
        .agg(
            F.collect_set("label").alias("more"),
            F.max(both / F.size("ranks")).alias("best"),
        )
    )
