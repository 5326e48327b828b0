"""Documents drawn by how much more likely the target texts make their words.

Features are single words and pairs of neighbouring words, hashed into buckets. A bucket's gain
says how much more frequent it is among the target texts, a document's weight is the mean gain
of its features, and noise that follows from the doc_id turns the largest scores into a random
sample by weight.

Nothing is sorted to draw. The scores are written once, and the key of the last document to be
drawn is found by bisection: exact counts of what lies below a threshold, over the score, then
over the doc_id of equal scores. Only the drawn rows are then partitioned by range for ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.llm import words
from skyvane.llm.storage import stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Bytes of a word that are hashed side by side with other words'; longer ones one at a time.
_ABREAST = 64
_ROW_BITS = 33


def resampled(
    documents: DataFrame,
    target: DataFrame,
    carry: tuple[str, ...] = (),
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """The columns ``doc_id``, ``carry`` and ``n_words, n_features, weight, score, rank`` of every
    row of ``documents(doc_id, text)``; ``rank`` counts from 1 among the drawn, others have null.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred with the highest
    scores are drawn. Words are runs of ASCII letters and digits and of anything outside ASCII,
    A-Z lower-cased; a null text has none, and a text without features the weight 0. Equal scores go
    by doc_id, rows without one come last, and of rows equal in both as many are drawn as are due;
    which of them is fixed once the scores are written. Repeated rows count each. ``doc_id`` is
    an integer; other columns are ignored.
    """
    spark = documents.sparkSession
    gains = _gains(_bucket_counts(documents, buckets), _bucket_counts(target, buckets))
    shared = spark.sparkContext.broadcast(gains)  # one number a bucket
    own = documents.select("doc_id", *carry, "text")
    schema = documents.select("doc_id", *carry).schema.simpleString()[7:-1].replace(":", " ")
    scored = stored(
        own.mapInArrow(
            _scorer(shared, ("doc_id", *carry), seed),
            schema + ", n_words bigint, n_features bigint, weight bigint, score bigint",
        ).withColumn("_row", F.monotonically_increasing_id()),
        "scores",
    )
    may = scored.where(F.col("n_words") >= least_words)
    wanted = may.count() * percent // 100
    names = ["doc_id", *carry, "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    # In the order that documents are drawn in.
    keys = {
        "down": -F.col("score"),
        "unnamed": F.col("doc_id").isNull().cast("long"),
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "row": F.col("_row"),
    }
    last = _key_at(may, keys, wanted)
    drawn = (F.col("n_words") >= least_words) & (
        F.struct(*(key.alias(name) for name, key in keys.items()))
        <= F.struct(*(F.lit(value).cast("long").alias(name) for name, value in last.items()))
    )
    return _ranked(scored.where(drawn), list(keys.values())).select(*names, "rank").unionByName(
        scored.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))
    )


def _key_at(rows: DataFrame, keys: dict[str, Column], place: int) -> dict[str, int]:
    """The keys of the row at ``place``, from 1, in the order of the ``keys``.

    Each key is bisected among the rows that equal the keys found before it, by exact counts.
    """
    found = {}
    for name, key in keys.items():
        low, high = rows.agg(F.min(key), F.max(key)).first()
        while low < high:
            middle = (low + high) // 2
            if rows.where(key <= middle).count() >= place:
                high = middle
            else:
                low = middle + 1
        place -= rows.where(key < low).count()
        rows = rows.where(key == low)
        found[name] = low
    return found


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` by ``order``: pieces cut by range, sorted each, and offset by those before.

    An id that grows along a sorted piece holds the piece and the place in it. It is written, as
    the cuts depend on a sample.
    """
    pieces = stored(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "drawn",
    )
    piece = F.shiftright("_at", _ROW_BITS)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row a piece
        pieces.groupBy(piece.alias("_piece"))
        .agg(F.count("*").alias("_n"))
        .select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        pieces.withColumn("_piece", piece)
        .join(offsets, "_piece")
        .withColumn("rank", F.col("_before") + place + 1)
    )


def _gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    more_raw, more_target = int(raw.sum()) + len(raw), int(target.sum()) + len(target)
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * more_raw) / ((s + 1) * more_target)))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def _bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. A task sends one row a bucket."""
    rows = (
        texts.select("text")
        .mapInArrow(_counter(buckets), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n"))
        .collect()
    )
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in words.blocks(batch.column("text"), separators=words.SIGNS):
                single, pairs, _ = feature_codes(block)
                for codes in (single, pairs):
                    total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"]
        )

    return run


def _scorer(shared, carry: tuple[str, ...], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        buckets = np.uint32(len(gains))
        for batch in batches:
            for block in words.blocks(batch.column("text"), separators=words.SIGNS):
                single, pairs, pair_first = feature_codes(block)
                n_words = block.counts()
                n_features = n_words + np.diff(pair_first)
                total = _per_text(gains[single % buckets], block.first)
                total += _per_text(gains[pairs % buckets], pair_first)
                weight = np.floor_divide(total, np.maximum(n_features, 1))
                here = batch.slice(block.row, block.n_texts)
                noise = [_noise(seed, doc_id) for doc_id in here.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(here.column(name) for name in carry),
                        pa.array(n_words),
                        pa.array(n_features),
                        pa.array(weight),
                        pa.array(weight + np.array(noise, dtype=np.int64)),
                    ],
                    [*carry, "n_words", "n_features", "weight", "score"],
                )

    return run


def _noise(seed: int, doc_id: int | None) -> int:
    """A thousandfold Gumbel variate that follows from the id; a null id is empty."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def feature_codes(block: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word, of each pair of neighbouring words of a text with one space between
    them, and the first pair of each text and the end."""
    n = len(block.starts)
    fresh = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    state = _read_on(fresh, block.data, block.starts, block.ends)
    joined = np.ones(n, dtype=bool)
    joined[block.first[:-1][block.first[:-1] < n]] = False
    second = np.flatnonzero(joined)
    before = _step(state[second - 1], np.uint8(0x20))
    pairs = _read_on(before, block.data, block.starts[second], block.ends[second])
    return ~state, ~pairs, np.searchsorted(second, block.first)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        odd = (table & 1).astype(bool)
        table = np.where(odd, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & 255] ^ (state >> 8)


def _read_on(
    state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> np.ndarray:
    """The states of the checksum after the bytes of each word, all words a byte at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    falling, at, out = -lengths[order], starts[order], state[order]
    for k in range(min(int(lengths.max(initial=0)), _ABREAST)):
        m = np.searchsorted(falling, -k, side="left")
        out[:m] = _step(out[:m], data[at[:m] + k])
    for word in range(int(np.searchsorted(falling, -_ABREAST, side="left"))):
        rest = data[at[word] + _ABREAST : at[word] - falling[word]].tobytes()
        out[word] = zlib.crc32(rest, int(out[word]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back
