from __future__ import annotations

import pytest

LONG = " ".join(f"w{k % 977} # x|y" for k in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps under a tall green tree"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing names."""
    rows = [
        (1, PROSE, "en", "a"),
        (1, PROSE, "en", "a"),
        (2, PROSE.upper(), "en", "a"),
        (3, PROSE + " now", None, "a"),
        (4, None, "en", None),
        (5, "", "en", "a"),
        (6, " \t\n ", None, None),
        (7, "word", "en", "a"),
        (8, LONG, "en", "b"),
        (9, LONG + " end", "en", "b"),
        (None, PROSE, "en", "a"),
        (None, None, None, None),
        (10, "12 34 !!", "en", "a"),
        (11, "Été à la plage, ça va\x0bbien \u3000 oui", "fr", "b"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    names = ["score", "kept", "node", "matches", "row", "_words", "topic", "weight", "n_words"]
    extra = [f"'{name}' AS {name}" for name in names]
    return spark.createDataFrame(rows, schema).selectExpr("*", *extra)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
