"""Operators over documents against brute force and on odd tables."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from llm_tables import no_documents, odd_documents  # noqa: F401
from skyvane.llm import (
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    quality_rules,
    words,
)
from skyvane.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def texts(df) -> dict:
    return {row.doc_id: row.text or "" for row in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_words_and_hashes():
    given = ["Ab  c\tAB", None, "", " x", "é\u3000é A", "y" * 100_000, "y" * 100_000 + "z"]
    block = words.Block(pa.array(given), 0)
    expected = [WORD.findall((t or "").translate(LOWER)) for t in given]
    assert [w.decode() for w in block.words()] == [w for own in expected for w in own]
    assert block.counts().tolist() == [len(own) for own in expected]
    codes = dict(zip(block.words(), block.hashes().tolist()))
    assert len(set(codes.values())) == len(codes)
    alone = words.Block(pa.array(["c"]), 0)
    assert alone.hashes()[0] == codes[b"c"]


def shingle_set(text: str) -> frozenset:
    own = WORD.findall(text.translate(LOWER))
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[k : k + 5]) for k in range(len(own) - 4))


def groups_of(sets: dict) -> dict:
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    items = sorted(sets)
    for a in items:
        for b in items:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in items}


def test_near_duplicates_are_the_components_of_all_links(spark):
    picked = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {k: shingle_set(t) for k, t in texts(picked).items()}
    expected = groups_of(sets)
    for row in QUERIES["op1_near_dedup"](spark, SMALL).collect():
        assert row.component_id == expected[row.doc_id]
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.kept == (row.component_id == row.doc_id)


def test_near_copies_far_from_the_smallest_member_and_small_blocks(spark):
    """A chain of near copies, and many texts that share most of a passage."""
    base = [f"b{k}" for k in range(200)]
    rows = []
    for step in range(30):  # each is close to the next, the ends are far apart
        own = base[:]
        for k in range(step):
            own[k * 6] = f"c{k}"
        rows.append((1000 - step, " ".join(own)))
    for k in range(60):  # half of a common passage
        rows.append((2000 + k, " ".join(base[:100] + [f"u{k}_{j % 50}" for j in range(100)])))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    expected = groups_of({k: shingle_set(t) for k, t in rows})
    assert len(set(expected.values())) > 2
    for limit in (1 << 20, 2000):
        found = near_dedup.near_duplicates(given, block_shingles=limit).collect()
        assert {r.doc_id: r.component_id for r in found} == expected


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id}
    assert found[1] == (14, 1, True) and found[2] == (14, 1, False) and found[3] == (15, 1, False)
    assert found[4] == (0, 4, True)
    assert found[5] == (0, 5, True) and found[6] == (0, 6, True) and found[7] == (1, 7, True)
    assert found[9][1] == 8
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(no_documents).collect() == []


def test_language_of_held_out_texts(spark):
    rows = QUERIES["op3_language_id"](spark, SMALL).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(langs)
    kept_back = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(langs[r.doc_id] == r.lang_pred for r in kept_back)
    assert right >= 0.97 * len(kept_back)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(documents, odd_documents, no_documents):
    model = language_id.fit(documents)
    rows = language_id.with_language(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    for missing in (4, 5, 6, 10):
        assert found[missing] == ("und", 0.0)
    assert found[7][0] in model.languages and rows[0].kept == "kept"
    assert language_id.with_language(no_documents, model).collect() == []
    nothing = language_id.fit(no_documents)
    assert {r.lang_pred for r in language_id.with_language(odd_documents, nothing).collect()} == {"und"}


def test_backoff_takes_the_longest_known_piece(spark):
    rows = [(1, "haus baum haus", "de"), (2, "house tree house", "en"), (3, "x", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert np.allclose(model.unseen("haust"), model.gram_logs[[model.grams["<haus"]]].mean(axis=0))
    assert model.predict("haust", {})[0] == "de"
    assert model.unseen("ζζ").tolist() == [0.0, 0.0]


def test_all_words_and_languages_of_the_sample_are_learnt(spark):
    letters = "abcdefghij"
    many = ["".join(letters[int(d)] for d in f"{k:05d}") for k in range(40_000)]
    rows = [(k, " ".join(many[k * 100 : k * 100 + 100]), "xx") for k in range(400)]
    rows += [(1000 + k, f"q{chr(0x4E00 + k) * 3} z", f"l{k:03d}") for k in range(230)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(given)
    assert len(model.languages) == 231
    assert len(model.words) == 40_000 + 230 + 1
    assert (model.words.rows(many) >= 0).all()
    for k in (0, 100, 229):
        own = model.word_logs[[model.words[f"q{chr(0x4E00 + k) * 3}"]]][0]
        assert model.languages[int(own.argmax())] == f"l{k:03d}"
    # Log frequencies by their definition.
    size = len(model.words)
    row = model.word_logs[[model.words[many[7]]]][0]
    assert row[model.languages.index("xx")] == pytest.approx(np.log(1.5 / (40_000 + size / 2)))
    assert row[model.languages.index("l000")] == pytest.approx(np.log(0.5 / (2 + size / 2)))
    few = language_id.fit(given, most_documents=231)
    assert few.languages == model.languages and len(few.words) == 100 + 230 + 1


def by_definition(model, text):
    """Language and score of one text, word by word."""
    counts = Counter(language_id._WORD.findall((text or "").lower()))
    if not counts:
        return "und", 0.0
    total = model.prior.copy()
    for word, n in counts.items():
        row = model.words.rows([word])
        if row[0] >= 0:
            total += n * model.word_logs[row][0]
            continue
        padded = f"<{word}>"
        for size in range(model.longest, 0, -1):
            row = model.grams.rows([padded[k : k + size] for k in range(len(padded) - size + 1)])
            if (row >= 0).any():
                total += n * model.gram_logs[row[row >= 0]].mean(axis=0)
                break
    n = counts.total()
    shares = np.exp((total - total.max()) * min(n, language_id.EVIDENCE_WORDS) / n)
    return model.languages[int(total.argmax())], shares.max() / shares.sum()


def test_texts_judged_in_blocks_are_judged_as_by_themselves(spark, monkeypatch):
    learnt = [
        (1, "haus baum der wald und das haus geht größe straße", "de"),
        (2, "house tree the wood and the house goes over there", "en"),
        (3, "maison arbre le bois et la forêt été où ça va", "fr"),
        (4, "дом дерево лес и этот дом ΟΔΟΣ δρόμος σας", "xx"),
    ]
    model = language_id.fit(spark.createDataFrame(learnt, "doc_id long, text string, lang string"))
    rng = np.random.default_rng(5)
    pool = " ".join(text for _, text, _ in learnt).split()
    pool += ["HÄUSER", "housing", "Σ", "ΟΔΟΣ.", "İde", "12", "a_b", "x²", "½", "ζζ", "森", "<haus>"]
    given = [None, "", " ", "12 !", "haus", "ΑΣ", "Σας ΑΣ", "q" * 70_000, "ß\nhaus\n"]
    for n in rng.integers(1, 30, 300).tolist():
        given.append(rng.choice([" ", "\n", "-"]).join(rng.choice(pool, n)))
    given.append(" ".join(rng.choice(pool, 3000)))
    expected = [by_definition(model, text) for text in given]
    # In one block, in blocks that cut texts, and with few sums at a time.
    for part, cells in ((1 << 20, 1 << 20), (40, 1 << 20), (1000, 9)):
        monkeypatch.setattr(language_id, "_PART", part)
        monkeypatch.setattr(language_id, "_CELLS", cells)
        found, scores = model.predict_all(given)
        assert found == [lang for lang, _ in expected]
        assert np.allclose(scores, [score for _, score in expected])
    assert model.predict_all([]) == ([], [])


def test_lookups_do_not_grow_with_the_number_of_texts(spark, monkeypatch):
    rows = [(1, "haus baum haus", "de"), (2, "house tree house", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    given = [f"haus tree unseen{'abcdefghij'[k % 10]} zweite" for k in range(2000)]
    calls = []
    inner = language_id.words.word_hashes

    def counted(*given):
        calls.append(len(given[1]))
        return inner(*given)

    monkeypatch.setattr(language_id.words, "word_hashes", counted)
    found, _ = model.predict_all(given)
    assert len(found) == 2000 and len(calls) <= 1 + language_id.LONGEST_GRAM


def test_copies_of_benchmark_passages_are_found(spark):
    rows = QUERIES["op4_decontamination"](spark, SMALL).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id].add(r.item_id)
    items = {
        r.item_id: " ".join(PLAIN.findall(r.text.translate(LOWER)))
        for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    }
    expected = defaultdict(set)
    for doc, text in texts(spark.read.parquet(f"{SMALL}/documents.parquet")).items():
        flat = f" {' '.join(PLAIN.findall(text.translate(LOWER)))} "
        for item, own in items.items():
            if f" {own} " in flat:
                expected[doc].add(item)
    assert found == expected and expected


def test_paraphrases_and_clean_texts(spark):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in benchmark.orderBy("item_id").limit(12).collect()]
    filler = [f"filler{k}" for k in range(400)]
    rows = []
    for item, own in items:
        changed = [f"new{k}" if k % 4 == 0 and k < len(own) - 5 else w for k, w in enumerate(own)]
        rows.append((item, " ".join(filler[:90] + changed + filler[90:200])))
        rows.append((1000 + item, " ".join(filler + own[: len(own) // 3])))
    rows += [(5000, None), (5001, ""), (None, " ".join(items[0][1])), (5002, "one two")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("idf", F.lit(1))
    matched = decontamination.with_matches(documents, benchmark).collect()
    assert len(matched) == len(rows) and matched[0].idf == 1
    hits = {r.doc_id: [m.item_id for m in r.matches] for r in matched}
    right = sum(hits[item] == [item] for item, _ in items)
    assert right >= 0.9 * len(items)
    assert not any(hits[1000 + item] for item, _ in items)
    assert hits[5000] == hits[5001] == hits[5002] == [] and hits[None] == [items[0][0]]
    split = decontamination.with_matches(documents, benchmark, block_items=5).collect()
    again = {r.doc_id: [m.item_id for m in r.matches] for r in split}
    assert sum(again[item] == [item] for item, _ in items) >= 0.9 * len(items)
    for empty in (documents.where("false"), documents):
        none = decontamination.with_matches(empty, benchmark.where("false")).collect()
        assert all(r.matches == [] for r in none)


def test_basis_is_orthonormal_and_spans():
    rng = np.random.default_rng(2)
    given = rng.standard_normal((5000, 8)).astype(np.float32) * np.float32([1, 9, 1, 1, 30, 1, 1, 2])
    basis = decontamination._orthonormal(given)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-4)
    assert np.allclose(basis @ (basis.T @ given), given, atol=1e-2)
    given[:, 3] = given[:, 1]
    assert np.isfinite(decontamination._orthonormal(given)).all()
    assert not decontamination._orthonormal(np.zeros((9, 3), dtype=np.float32)).any()


def planted(n_items: int, every: int):
    """Items drawn from a skewed vocabulary, and documents with every so many of them: copies,
    copies beside a repeated word or line of the benchmark's own words, and paraphrases."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"v{k}" for k in range(3000)])
    odds = 1 / np.arange(2, 3002)
    odds /= odds.sum()

    def drawn(n):
        return list(rng.choice(vocabulary, n, p=odds))

    items = {k: drawn(int(rng.integers(12, 60))) for k in range(n_items)}
    rows, kinds = [], defaultdict(list)
    for item in range(0, n_items, every):
        own = items[item]
        changed = [f"n{j}" if j % 4 == 0 and j < len(own) - 5 else w for j, w in enumerate(own)]
        line = drawn(6)
        for kind, text in (
            ("copy", drawn(70) + own + drawn(70)),
            ("word", ["v0"] * 40 + own + ["v0"] * 40),
            ("line", line * 8 + own + line * 8),
            ("paraphrase", drawn(70) + changed + drawn(70)),
            ("clean", drawn(200)),
        ):
            kinds[kind].append((len(rows), item))
            rows.append((len(rows), " ".join(text)))
    return items, rows, kinds


def matched_by_hand(items: dict, rows: list) -> set:
    """Confirmed pairs over windows of every place and of the lengths that are searched."""
    found = set()
    for doc, text in rows:
        own = np.array([hash(w) for w in text.split()])
        for item, passage in items.items():
            p = np.array([hash(w) for w in passage])
            if len(set(passage) & set(text.split())) < 0.5 * len(set(passage)):
                continue
            size = 8 << max(0, math.ceil(math.log2(max(len(p), 1) / 16)))
            for at in range(0, max(len(own) - 2 * size, 1), size):
                window = own[at : at + 3 * size]
                common = decontamination.common_subsequence(p, window)
                answer = decontamination.common_subsequence(p[-5:], window) == len(p[-5:])
                if common >= math.ceil(0.8 * len(p) - 1e-9) or (
                    common >= math.ceil(0.6 * len(p) - 1e-9) and answer
                ):
                    found.add((doc, item))
    return found


def test_cosines_pick_what_can_be_confirmed(spark):
    """The search against all pairs that can be confirmed, and those against brute force."""
    items, rows, kinds = planted(200, 4)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(
        [(k, " ".join(own)) for k, own in items.items()], "item_id long, text string"
    )

    def pairs(**how):
        matched = decontamination.with_matches(documents, benchmark, **how).collect()
        return {(r.doc_id, m.item_id) for r in matched for m in r.matches}

    every, found = pairs(exact=True), pairs()
    assert found <= every and every == matched_by_hand(items, rows)
    for kind, own in kinds.items():
        docs = {doc for doc, _ in own}
        right = {pair for pair in every if pair[0] in docs}
        assert len(found & right) >= 0.9 * len(right), kind
        assert kind == "clean" or len(right) >= 0.9 * len(own), kind
    # Without the latent space there are no candidates.
    assert pairs(least_cosine=1.01) == set()
    one = pairs(rank=1)
    assert one < found


def test_copies_of_2000_items_are_found_beside_repeated_text(spark):
    items, rows, kinds = planted(2000, 10)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(
        [(k, " ".join(own)) for k, own in items.items()], "item_id long, text string"
    )
    found = {
        r.doc_id: {m.item_id for m in r.matches}
        for r in decontamination.with_matches(documents, benchmark).collect()
    }
    exact = {
        r.doc_id: {m.item_id for m in r.matches}
        for r in decontamination.with_matches(documents, benchmark, exact=True).collect()
    }
    for kind, pairs in kinds.items():
        right = sum(len(exact[doc]) for doc, _ in pairs)
        caught = sum(len(exact[doc] & found[doc]) for doc, _ in pairs)
        assert caught >= 0.9 * right, kind
        if kind in ("copy", "word", "line"):
            assert len(pairs) >= 100 and all(item in exact[doc] for doc, item in pairs)


def test_the_space_is_fitted_on_all_passages_of_all_documents(spark):
    """Cosines against a dense decomposition, with more documents than 800, one of more than 40
    passages, repeated and missing ids and documents without a word of the benchmark."""
    rng = np.random.default_rng(7)
    items = [list(rng.choice([f"v{k}" for k in range(120)], 20)) for _ in range(6)]
    held = sorted({w for own in items for w in own})
    topics = [held[k : k + 12] for k in range(0, len(held), 12)]
    rows = [(k, list(rng.choice(topics[k % len(topics)], 30))) for k in range(900)]
    rows += [(k % 3 or None, list(rng.choice(topics[0] + ["other"], 90))) for k in range(200)]
    rows += [(2000, list(rng.choice(topics[1], 48 * 300))), (2001, ["other"] * 60), (2002, [])]
    rows += [(3000 + k, own + ["other"] * 4 + topics[2]) for k, own in enumerate(items)]

    codes = {w: decontamination._words_of(w)[0] for w in held}
    place = {w: k for k, w in enumerate(sorted(held, key=codes.get))}
    spread = Counter(w for _, own in rows for w in set(own))
    idf = np.array([math.log((len(rows) + 1) / (spread[w] + 1)) + 1e-3 for w in place])

    def vector(own):
        out = np.zeros(len(place))
        for word, n in Counter(own).items():
            if word in place:
                out[place[word]] = (1 + math.log(n)) * idf[place[word]]
        return out / max(np.linalg.norm(out), 1e-12)

    parts = [own[at : at + 48] for _, own in rows for at in range(0, len(own), 48)]
    parts = np.array([vector(own) for own in parts if place.keys() & set(own)])
    queries = np.array([vector(own) for own in items])
    drawn = np.random.Generator(np.random.PCG64(11))
    basis = np.linalg.qr(drawn.standard_normal((len(place), 6), dtype=np.float32))[0]
    scale = 20 * len(items) / len(parts)
    assert scale < 0.1
    for _ in range(2):
        whole = 20 * queries.T @ (queries @ basis) + scale * parts.T @ (parts @ basis)
        basis = np.linalg.qr(whole)[0]

    documents = spark.createDataFrame(
        [(doc, " ".join(own)) for doc, own in rows], "doc_id long, text string"
    ).repartition(5)
    benchmark = spark.createDataFrame(
        [(k, " ".join(own)) for k, own in enumerate(items)], "item_id long, text string"
    )
    matched = decontamination.with_matches(documents, benchmark, least_cosine=-1.0).collect()
    assert len(matched) == len(rows)
    found = {(r.doc_id, m.item_id): m.cosine for r in matched for m in r.matches}
    for item, own in enumerate(items):
        one, two = vector(rows[item - len(items)][1]) @ basis, queries[item] @ basis
        cosine = one @ two / np.linalg.norm(one) / np.linalg.norm(two)
        assert found[3000 + item, item] == pytest.approx(cosine, abs=1e-4)


def test_decontamination_of_the_pipeline_fits_on_all_passages(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(9)
    items = [[f"v{k}" for k in range(at, at + 20)] for at in (0, 20, 40)]
    held = {w for own in items for w in own}
    mixed = np.array([*sorted(held), *(f"n{k}" for k in range(200))])
    rows = [(k // 2 if k % 9 else None, list(rng.choice(mixed, 10 + k % 90)), k) for k in range(900)]
    rows += [(5000, list(rng.choice(mixed, 48 * 60 + 1)), 900), (None, [], 901), (1, ["n1"] * 99, 902)]
    rows += [(6000 + k, ["n1"] * 9 + own + ["n2"] * 9, -1 - k) for k, own in enumerate(items)]
    spark.createDataFrame(
        [(k, " ".join(own)) for k, own in enumerate(items)], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    documents = spark.createDataFrame(
        [(doc, " ".join(own) if own else None, n) for doc, own, n in rows],
        "doc_id long, text string, n long",
    ).repartition(4)

    written, stored = [], decontamination.stored

    def kept(df, purpose):
        written.append(stored(df, purpose))
        return written[-1]

    monkeypatch.setattr(decontamination, "stored", kept)
    left = corpus_pipeline.decontaminated(spark, documents, str(tmp_path)).collect()
    assert sorted(r.n for r in left) == list(range(903))
    parts = [Counter(own[at : at + 48]) for _, own, _ in rows for at in range(0, len(own), 48)]
    parts = [[n for word, n in own.items() if word in held] for own in parts]
    passages = written[0].collect()
    assert len(written) == 1 and len(passages) == len(rows)
    assert sum(len(r.sizes) for r in passages) == sum(len(own) > 0 for own in parts)
    assert sum(sum(r.times) for r in passages) == sum(map(sum, parts))
    assert sorted(b"".join(bytes(r.sizes) for r in passages)) == sorted(len(o) for o in parts if o)
    assert sum(len(r.features) for r in passages) == 4 * sum(map(len, parts))


def test_passages_at_the_end_of_very_long_texts_are_found(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    long = " ".join(f"w{k % 5000}" for k in range(400_000))  # more than one block of text
    rows = [(1, f"{long} {passage}"), (2, long), (3, f"{passage} {long}"), (4, f"{long} {passage} {long}")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, passage), (8, "other words")], "item_id long, text string")
    matched = decontamination.with_matches(documents, benchmark).collect()
    assert {r.doc_id: [(m.item_id, m.lcs) for m in r.matches] for r in matched} == {
        1: [(7, 30)], 2: [], 3: [(7, 30)], 4: [(7, 30)]
    }


def test_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 20)
        table = np.zeros((13, 21), dtype=int)
        for i in range(12):
            for j in range(20):
                table[i + 1, j + 1] = (
                    table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
                )
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


def backoff_scores(docs: dict, training: list, order: int, strength: float) -> dict:
    """Scores by their definition, from the counts of all sequences."""
    tokens = {k: [*WORD.findall(t.translate(LOWER)), ""] for k, t in docs.items()}
    c1 = Counter(w for k in training for w in tokens[k])
    n, v = sum(c1.values()), len(c1)
    counts = Counter()
    for k in training:
        own = ["<s>", *tokens[k]]
        for length in range(1, order + 1):
            counts.update(tuple(own[i : i + length]) for i in range(len(own) - length + 1))

    def chance(history, w):
        if not history:
            return (c1[w] + 1) / (n + v + 1)
        shorter = chance(history[1:], w)
        return (counts[*history, w] + strength * shorter) / (counts[history] + strength)

    out = {}
    for k, own in tokens.items():
        seq = ["<s>", *own]
        score = sum(
            math.log10(chance(tuple(seq[max(i - order + 1, 0) : i]), seq[i]))
            for i in range(1, len(seq))
        )
        base = sum(math.log10(chance((), w)) for w in own)
        out[k] = (len(own), sum(w in c1 for w in own), n, base, score)
    return out


def same_scores(rows, expected) -> None:
    assert len(rows) == len(expected)
    for r in rows:
        n_tokens, n_known, n, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize(
    "order, strength, sizes",
    [(3, 4.0, {}), (3, 0.5, {"block_tokens": 5000, "share_names": 20_000}), (1, 4.0, {}), (4, 9.0, {})],
)
def test_scores_follow_their_definition(documents, order, strength, sizes):
    """Also in many blocks and shares, learnt from other rows or from rows of the same table."""
    held = language_id.held_out("doc_id", 7, 2)
    docs = texts(documents)
    training = [k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    expected = backoff_scores(docs, training, order, strength)
    for given in (documents.where(~held), ~held):
        rows = lm_scoring.lm_scores(documents, given, order, strength, **sizes)
        same_scores(rows.collect(), expected)
    if order == 3 and strength == lm_scoring.STRENGTH:
        same_scores(QUERIES["op5_lm_scoring"](documents.sparkSession, SMALL).collect(), expected)


def test_scores_use_every_sequence_of_a_large_corpus(spark):
    """One pair among 450,000 tokens still has its arcs."""
    filler = " ".join(f"w{k % 300}" for k in range(30_000))
    rows = [(k, filler) for k in range(15)] + [(100, "rare pair here"), (101, "here pair rare")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    docs = dict(rows)
    expected = backoff_scores(docs, [k for k in docs if k != 101], 3, lm_scoring.STRENGTH)
    found = lm_scoring.lm_scores(given, given.where("doc_id != 101"), block_tokens=50_000).collect()
    same_scores(found, expected)
    found = {r.doc_id: r for r in found}
    assert found[100].score > found[101].score + 1


def test_a_frequent_word_is_one_name_a_block(spark):
    """A third of all tokens are one word, which is followed by thousands of others."""
    rnd = np.random.default_rng(1)
    rows = [
        (k, " ".join(w for x in rnd.integers(0, 4000, 300) for w in ("hot", f"w{x}", f"v{x % 7}")))
        for k in range(60)
    ]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = backoff_scores(dict(rows), [k for k, _ in rows if k % 5], 3, lm_scoring.STRENGTH)
    found = lm_scoring.lm_scores(
        given, F.col("doc_id") % 5 != 0, block_tokens=6000, share_names=9000
    )
    same_scores(found.collect(), expected)


def automaton(texts_, learns, order=3, strength=4.0):
    """A block's automaton, its places, and the probabilities of all words after a state."""
    batch = pa.RecordBatch.from_pydict(
        {"text": texts_, "scored": [True] * len(texts_), "learns": learns}
    )
    (block,) = lm_scoring._blocks((), 10**9)(iter([batch]))
    (lists,) = [pa.Table.from_batches(lm_scoring._named(order, 1)(iter([
        pa.RecordBatch.from_arrays(
            [pa.array([0]), *(block.column(k) for k in ("learns", "n_words", "known_words", "places"))],
            ["block", "learns", "n_words", "known_words", "places"],
        )])))]
    answers = lm_scoring._added_up(lists)
    totals = [lm_scoring._unpacked(x.as_py()) for x in answers.column("totals")]
    n, v = block.column("n_learnt")[0].as_py(), sum(answers.column("n_distinct").to_pylist())
    own = lm_scoring._Places(
        block.column("known_words")[0].as_py(),
        block.column("places")[0].as_py(),
        np.asarray(block.column("n_words")[0].values),
    )
    return lm_scoring.Automaton(own, totals, order, strength, n, v), own, v


def test_probabilities_after_every_state_sum_to_one():
    given = ["a b a c a b", "b b a", "c a b a b c", ""]
    own, places, v = automaton(given, [True] * 4)
    assert v == 4
    vocabulary = np.array([w for w in range(len(places.hashes)) if w != places.start])
    over = own.next[own.codes % own.n_words == places.end]  # nothing follows an end
    for state in set(range(len(own.fail))) - set(over.tolist()):
        _, logs = own.read(np.full(len(vocabulary), state), vocabulary)
        unknown = 10**own.unseen
        while state != own.root:
            unknown *= 10 ** own.fail_weight[state]
            state = own.fail[state]
        assert (10**logs).sum() + unknown == pytest.approx(1, rel=1e-12)


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_are_read_as_whole_texts_are(piece):
    given = ["a b a c a b unseen a b c", "b b a", "", "c a b a b c zz zz a b a c"]
    own, places, _ = automaton(given, [True, True, True, False])
    whole, parts = own.walk(places, 3, 10**6), own.walk(places, 3, piece)
    assert parts.tolist() == pytest.approx(whole.tolist(), rel=1e-12)


def test_packed_numbers_come_back():
    for numbers in ([], [0], [5, 0, 255], [2**64 - 1, 0, 2**40], list(range(1000))):
        given = np.array(numbers, dtype=np.uint64)
        assert lm_scoring._unpacked(lm_scoring._packed(given)).tolist() == numbers
        if numbers:
            rising = np.sort(given)
            packed = lm_scoring._packed_rising(rising)
            assert lm_scoring._unpacked_rising(packed).tolist() == rising.tolist()


def test_scores_of_odd_rows(odd_documents, no_documents):
    rows = lm_scoring.lm_scores(odd_documents, odd_documents).collect()
    assert len(rows) == odd_documents.count()
    found = {r.doc_id: r for r in rows}
    assert found[4].n_tokens == found[5].n_tokens == found[6].n_tokens == 1
    assert found[4].score == found[5].score and found[7].n_known == 2
    untrained = lm_scoring.lm_scores(odd_documents, no_documents).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}
    assert lm_scoring.lm_scores(no_documents, odd_documents).collect() == []


def marks_by_hand(text: str) -> tuple:
    text = text.translate(LOWER)
    own, places, base = PLAIN.findall(text), [], set()
    for phrase, label in license_scan.PHRASES.items():
        k = phrase.split()
        for at in range(len(own)):
            if own[at : at + len(k)] == k:
                places.append(at)
                base.add(label)
    labels, best = set(base), 0.0
    for line in text.split("\n"):
        held = set(PLAIN.findall(line))
        for label, template in license_scan.TEMPLATES:
            need = set(template.split())
            share = len(need & held) / len(need)
            if share >= license_scan.THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
    return (
        len(own),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        1.0 if places else best,
    )


def test_license_marks(spark, odd_documents, no_documents):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = [
        (-1, "CC BY CC by mit\nlicense GNU General-Public license"),
        (-2, "All rights\nreserved"),
        (-3, "this work is dedicated to the Public Domain. all rights reserved"),
        (-4, "x licensed under cc by sa 4.0 é"),
        (-5, None),
        (-6, "Kit licen\u017fe mit license"),
    ]
    given = documents.union(spark.createDataFrame(more, documents.schema))
    expected = texts(given)
    for r in license_scan.license_marks(given).collect():
        assert tuple(r)[1:] == marks_by_hand(expected[r.doc_id])
    rows = license_scan.license_marks(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert license_scan.license_marks(no_documents).collect() == []


def base_by_hand(text: str) -> tuple:
    own = WORD.findall(text)
    windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
    covered = {
        k + j for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for j in range(5)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(own),
        sum(map(len, own)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_statistics_and_rejections(spark, odd_documents, no_documents):
    docs = texts(spark.read.parquet(f"{SMALL}/documents.parquet"))
    quality = {
        r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    }
    rows = QUERIES["op10_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = base_by_hand(docs[r.doc_id])
        assert own == tuple(r)[1:6]
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r.kept and r.base_failed)
    judged = [r for r in rows if r.doc_id in quality and not r.base_failed]
    good = [r.kept for r in judged if quality[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good)
    assert any(not r.kept for r in judged)
    odd = quality_rules.judged(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    expected = texts(odd_documents)
    for r in odd:
        if r.doc_id is not None:
            assert base_by_hand(expected[r.doc_id]) == (
                r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
            )
        assert r.node == "node" and r._words == "_words"
    assert quality_rules.judged(no_documents).collect() == []


def test_outlying_vectors_are_rejected_and_ordinary_ones_kept(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"wor{chr(97 + k % 26)}{k}" for k in range(800)]
    rows = [
        (k, " ".join(rng.choice(vocabulary, 120)), "en", "hot" if k % 3 else None)
        for k in range(300)
    ]
    rows += [(900 + k, " ".join(w + "%%%" for w in rng.choice(vocabulary, 120)), "en", "hot") for k in range(30)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(given).collect()}
    assert all(kept[k] for k in range(300)) and not any(kept[900 + k] for k in range(30))


def raked(cells: dict, keep: float, flatten: float) -> dict:
    """Probabilities by raking (topic, lang, source) a thousand times, cells taken whole at most."""
    total = sum(cells.values())
    targets = []
    for d in range(3):
        held = Counter()
        for key, n in cells.items():
            held[key[d]] += n
        parts = {k: (n / total) ** flatten for k, n in held.items() if n}
        targets.append({k: p / sum(parts.values()) for k, p in parts.items()})
    mass = {k: n / total for k, n in cells.items() if n}
    most = {k: m / keep for k, m in mass.items()}
    for _ in range(1000):
        for d in range(3):
            for value, target in targets[d].items():
                own = [k for k in mass if k[d] == value]
                held = sum(mass[k] for k in own)
                whole = sum(mass[k] for k in own if mass[k] >= most[k] * (1 - 1e-12))
                for k in own:
                    if target <= held:
                        mass[k] *= target / held
                    elif mass[k] < most[k] * (1 - 1e-12):
                        mass[k] = min(most[k], mass[k] * (target - whole) / (held - whole))
    return {k: m / most[k] for k, m in mass.items()}


def test_mixing_follows_proportional_fitting(spark, odd_documents, no_documents):
    rows = QUERIES["op2_mixing"](spark, SMALL).collect()
    docs = texts(spark.read.parquet(f"{SMALL}/documents.parquet"))
    cells = Counter()
    for r in rows:
        assert r.tokens == len(WORD.findall(docs[r.doc_id]))
        cells[r.topic, r.lang, r.source] += r.tokens
    expected = raked(cells, mixing.KEEP, mixing.FLATTEN)
    for r in rows:
        own = expected.get((r.topic, r.lang, r.source), 0.0)
        assert r.probability == pytest.approx(own, rel=1e-2, abs=1e-4)
        assert (r.weight is None) != r.selected
    tokens = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(mixing.KEEP * tokens, rel=1e-3)
    again = QUERIES["op2_mixing"](spark, SMALL).collect()
    assert {r.doc_id for r in again if r.selected} == {r.doc_id for r in rows if r.selected}
    odd = mixing.mixed(odd_documents, {"lang": {"en": 0.5}}).collect()
    assert len(odd) == odd_documents.count() and odd[0].node == "node"
    assert mixing.mixed(no_documents).collect() == []


def mix_cells(spark, n_sources=12):
    rng = np.random.default_rng(9)
    rows = [
        (topic, lang, f"s{s}", int(rng.integers(1, 4000)) * (4 if s == 0 else 1))
        for topic in ("brief", "prose", "long")
        for lang in ("de", "en", "fr")
        for s in range(n_sources)
        if rng.random() < 0.8
    ]
    return spark.createDataFrame(rows, "topic string, lang string, source string, tokens long")


def test_sources_and_languages_hold_where_cells_are_taken_whole(spark):
    cells = mix_cells(spark)
    wanted = mixing.calibrated(cells, {}, 0.7, 100, 0.6)
    assert wanted.where("probability >= 1 - 1e-9").count() > 3
    for r in mixing.shares(wanted).collect():
        if r.dimension != "topic":
            assert r.expected == pytest.approx(r.target, abs=2e-3), r


def test_shares_that_cannot_be_met_are_reported(spark):
    cells = mix_cells(spark)
    wanted = mixing.calibrated(cells, {"source": {"s3": 0.6}, "lang": {"fr": 0.2}}, 0.5, 100, 0.7)
    found = {(r.dimension, r.value): r for r in mixing.shares(wanted).collect()}
    own = cells.where("source = 's3'").agg(F.sum("tokens")).first()[0]
    mix = wanted.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    poor = found["source", "s3"]
    assert poor.target == pytest.approx(0.6) and poor.expected == pytest.approx(own / mix)
    assert poor.expected < 0.3
    with pytest.raises(RuntimeError, match="1 rounds"):
        mixing.calibrated(cells, {}, 0.5, 1, 0.3)
