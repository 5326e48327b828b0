"""Whitening, importance resampling and token counts against brute force and on odd tables."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from llm_tables import PROSE, no_documents, odd_documents  # noqa: F401
from skyvane.llm import importance_sampling, token_counts, whitening
from skyvane.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Whitening.


def whitened_by_hand(vectors: dict, components: int) -> dict:
    kept = {
        k: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)
        for k, v in vectors.items()
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
    }
    unique = sorted(set(kept.values()))
    n = len(unique)
    sums = [sum(column) for column in zip(*unique)]
    x = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in unique])
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for k, row in kept.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        centred = np.array([(n * a - s) / n for a, s in zip(row, sums)])
        for c in range(min(components, int((values > 1e-9 * max(values[0], 1e-9)).sum()))):
            z = centred @ axes[:, c] / math.sqrt(values[c])
            out[k, c + 1] = (n, deviation, z, values[c] / values.sum())
    return out


def same_whitening(rows, expected) -> None:
    assert Counter((r.vec_id, r.component) for r in rows) == Counter(list(expected))
    sign = {}
    for r in rows:
        n, deviation, z, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
        if abs(z) > 1e-3:
            sign.setdefault(r.component, math.copysign(1, r.whitened * z))
        assert r.whitened * sign.get(r.component, 1) == pytest.approx(z, abs=1e-7)


def test_whitening_is_that_of_the_eigenvectors(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    expected = whitened_by_hand({r.vec_id: r.embedding for r in given}, 16)
    same_whitening(QUERIES["op11_whitening"](spark, SMALL).collect(), expected)


VECTORS = "vec_id long, embedding array<double>, n string, component string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "a", "b", "c") for k, v in rows], VECTORS)


def test_odd_vectors(spark):
    random = np.random.default_rng(3)
    good = {k: random.normal(size=5).tolist() for k in range(40)}
    good |= {50: good[0], 51: good[0], 52: [1e3, -2.5, 0.0, 3.0, 4.0]}
    bad = {60: None, 61: [], 62: [1.0, None, 0.0, 0.0, 0.0], 63: [math.nan] * 5}
    bad |= {64: [math.inf, 0.0, 0.0, 0.0, 0.0], 65: [1.0, 2.0]}
    table = vectors(spark, [*good.items(), *bad.items()])
    model = whitening.fit(table, components=16)
    assert model.width == 5 and model.n == 41
    rows = whitening.whitened(table, model, carry=("vec_id",)).collect()
    same_whitening(rows, whitened_by_hand(good, 16))
    named = vectors(spark, [(None, good[0]), (None, good[1]), (7, good[2]), (7, good[2])])
    assert whitening.whitened(named, model).count() == 20


def test_no_variance_no_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        table = vectors(spark, rows)
        out = whitening.whitened(table, whitening.fit(table))
        assert out.columns[:4] == ["vec_id", "component", "n", "deviation"]
        assert out.collect() == []


def _product(x):
    return lambda y: (x.T @ (x @ y), float((x @ y) @ (x @ y)))


@pytest.mark.parametrize("wanted", [1, 4, 16])
def test_repeated_singular_values_are_all_found(wanted):
    random = np.random.default_rng(5)
    left, _ = np.linalg.qr(random.normal(size=(300, 60)))
    right, _ = np.linalg.qr(random.normal(size=(60, 60)))
    given = np.concatenate([[9, 9, 9, 5, 5], 4 * 0.7 ** np.arange(45), np.zeros(10)])
    x = (left * given) @ right.T
    sizes, found = whitening._leading(_product(x), 60, wanted)
    assert sizes == pytest.approx(np.sort(given)[::-1][:wanted], abs=1e-12)
    assert np.linalg.norm(x @ found, axis=0) == pytest.approx(sizes, abs=1e-10)
    assert np.abs(found.T @ found - np.eye(wanted)).max() < 1e-12


def test_settled_components_end_early():
    random = np.random.default_rng(6)
    x = random.normal(size=(900, 200)) * 0.8 ** np.arange(200)
    calls = []
    product = _product(x)
    sizes, found = whitening._leading(lambda y: calls.append(1) or product(y), 200, 8)
    _, expected, across = np.linalg.svd(x)
    assert len(calls) < 120
    assert sizes == pytest.approx(expected[:8], rel=1e-13)
    assert np.abs(np.abs((found * across[:8].T).sum(axis=0)) - 1).max() < 1e-12


# Importance resampling.


def drawn_by_hand(documents: list, target: list, percent=25, least_words=20) -> list:
    def features(text):
        own = PLAIN.findall((text or "").translate(LOWER))
        runs = own + [f"{a} {b}" for a, b in zip(own, own[1:])]
        return len(own), [zlib.crc32(run.encode()) % 10_000 for run in runs]

    raw, aim = Counter(), Counter()
    for _, text in documents:
        raw.update(features(text)[1])
    for text in target:
        aim.update(features(text)[1])
    total, aimed = sum(raw.values()) + 10_000, sum(aim.values()) + 10_000
    out = []
    for doc_id, text in documents:
        n_words, buckets = features(text)
        gains = [
            math.floor(1000 * math.log((aim[b] + 1) * total / ((raw[b] + 1) * aimed)))
            for b in buckets
        ]
        weight = sum(gains) // len(gains) if gains else 0
        name = f"7:{'' if doc_id is None else doc_id}"
        h = int(sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(buckets), weight, score, None, n_words])
    may = [row for row in out if row[5] >= least_words]
    may.sort(key=lambda row: (-row[3], row[0] is None, row[0] or 0))
    for rank, row in enumerate(may[: percent * len(may) // 100], 1):
        row[4] = rank
    return [tuple(row[:5]) for row in out]


def order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v or 0) for v in row))


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_drawn_documents_are_those_of_the_formula(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = QUERIES["op12_importance_sampling"](spark, folder)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    expected = drawn_by_hand([tuple(r) for r in documents.collect()], target)
    assert order(tuple(r) for r in out.collect()) == order(expected)


def test_odd_documents_are_drawn(spark, odd_documents, no_documents):
    given = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(PROSE,), (None,), ("",)], "text string")
    for percent, least in ((25, 1), (60, 0), (100, 0), (50, 14)):
        out = importance_sampling.resampled(
            odd_documents, target, carry=("weight AS given",)[:0], percent=percent, least_words=least
        )
        rows = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
        expected = drawn_by_hand(given, [PROSE, None, ""], percent, least)
        assert order(rows) == order(expected)
    assert importance_sampling.resampled(no_documents, target).collect() == []
    nothing = importance_sampling.resampled(odd_documents, target.where("false"))
    assert nothing.count() == len(given)


def test_equal_scores_go_by_id_then_as_many_as_are_due(spark):
    rows = [(k // 7, "b" if k % 7 else "a", float(k % 2)) for k in range(700)]
    table = spark.createDataFrame(rows, "id long, name string, noise double").select(
        F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("score"), F.col("noise")
    )
    keyed = table.withColumn("_row", F.monotonically_increasing_id())
    keys = {"down": -F.col("score"), "id": F.col("doc_id"), "row": F.col("_row")}
    last = importance_sampling._key_at(keyed, keys, 325)
    assert (last["down"], last["id"]) == (-5, 46)
    assert keyed.where((F.col("doc_id") < 46) | (F.col("doc_id") == 46) & (F.col("_row") <= last["row"])).count() == 325


def test_checksums_of_long_and_foreign_words():
    import pyarrow as pa

    from skyvane.llm import words

    texts = ["a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "d" * 5000 + " é日本 x", "", None, "y"]
    block = words.Block(pa.array(texts), 0, words.SIGNS)
    single, pairs, first = importance_sampling.feature_codes(block)
    own = [PLAIN.findall(t or "") for t in texts]
    assert single.tolist() == [zlib.crc32(w.encode()) for ws in own for w in ws]
    both = [f"{a} {b}" for ws in own for a, b in zip(ws, ws[1:])]
    assert pairs.tolist() == [zlib.crc32(w.encode()) for w in both]
    assert np.diff(first).tolist() == [max(len(ws) - 1, 0) for ws in own]


# Token counts.


def counted(texts) -> list[int]:
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]


def test_token_counts_are_those_of_the_library(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    n = dict(zip((r.doc_id for r in given), counted(r.text for r in given)))
    size = {r.doc_id: len((r.text or "").encode()) for r in given}
    rows = QUERIES["op13_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(given)
    assert {r.doc_id: r.n_tokens for r in rows} == n
    assert {r.doc_id: r.n_bytes for r in rows} == size
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def hard_texts() -> list[str]:
    random = np.random.default_rng(8)
    alphabet = list("aZ09 \n\t'.,!éß日本語🙂　\xa0") + ["'re", "'ll", "<|endoftext|>", "  ", "\r\n"]
    drawn = ["".join(random.choice(alphabet, 900)) for _ in range(12)]
    return [
        *drawn,
        "<|endoftext|>" * 60,
        "x<|endoftext" * 70,
        "a" * 1500,
        " " * 1500 + "x",
        "we'll " * 200 + "y" * 700 + " they're" * 90,
        "\n" * 333 + "🙂" * 400,
        "1234567890" * 120 + " end",
        "日本" * 500,
    ]


@pytest.mark.parametrize("chunk, overlap", [(64, 40), (97, 97), (300, 30), (20, 18)])
def test_spliced_counts_are_those_of_whole_texts(spark, chunk, overlap):
    texts = hard_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_counts.token_counts(
        table, TOKENIZER, long_bytes=50, chunk_chars=chunk, overlap_chars=overlap
    )
    assert [r.n_tokens for r in out.orderBy("doc_id").collect()] == counted(texts)


def test_failed_alignment_widens(spark, monkeypatch):
    rounds = []
    splice = token_counts._spliced
    monkeypatch.setattr(token_counts, "_spliced", lambda *a: rounds.append(a[2:4]) or splice(*a))
    texts = ["b" * 3000, "plain words " * 300]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_counts.token_counts(
        table, TOKENIZER, long_bytes=50, chunk_chars=64, overlap_chars=64
    )
    assert [r.n_tokens for r in out.orderBy("doc_id").collect()] == counted(texts)
    assert rounds == [(64, 64), (512, 512), (4096, 4096)]


def test_odd_documents_are_counted(spark, odd_documents, no_documents):
    given = odd_documents.select("doc_id", "text").collect()
    out = token_counts.token_counts(odd_documents, TOKENIZER, carry=("doc_id", "weight"))
    expected = Counter(zip((r.doc_id for r in given), counted(r.text for r in given)))
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == expected
    assert token_counts.token_counts(no_documents, TOKENIZER).collect() == []


def test_other_tokenizers_are_refused(spark, odd_documents):
    with pytest.raises(ValueError):
        token_counts.token_counts(odd_documents, public_tokenizers.path("word_bpe_49k.json"))
