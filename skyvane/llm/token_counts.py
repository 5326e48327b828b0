"""Token counts of whole texts by a public byte-level tokenizer.

Most texts are encoded in batches where they are. A huge one is cut into chunks that overlap and
that Spark deals out like rows. Each chunk is encoded with offsets, and two neighbours are spliced
at a boundary that both have in their overlap:

* A byte-level tokenizer first cuts a text into pieces, from left to right, by a pattern that
  never looks back. From a true boundary between pieces on, they depend only on what follows it.
* The first chunk starts at a true boundary. A chunk that is right up to a boundary also gets
  the pieces behind it right, but for those near its end, where the pattern or a special string
  may look beyond it. Boundaries that near are not used.
* A boundary that the next chunk has too is therefore true, and that chunk is right from there on.

So counts up to and from the common boundary add up to those of the whole text. Where an overlap
holds no common boundary, the text is cut again with chunks and overlaps eight times as long, at
last into one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.llm import words
from skyvane.llm.storage import stored

LIMIT = 512
# Bytes from which a text is cut; characters of a chunk, and those it shares with the next one.
LONG_BYTES = 1 << 17
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
WIDER = 8
BATCH_BYTES = 1 << 20
# Characters that the pattern looks ahead, or fewer.
_AHEAD = 4


def token_counts(
    documents: DataFrame,
    tokenizer_file: str,
    carry: tuple[str, ...] = ("doc_id",),
    limit: int = LIMIT,
    long_bytes: int = LONG_BYTES,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """The columns ``carry`` and ``n_bytes, n_tokens, over_limit`` of every row of ``documents``.

    ``n_tokens`` is what the tokenizer makes of the whole text without added tokens, cuts or
    padding; its special strings inside a text are its special tokens. A null text is empty and
    has no tokens. Repeated rows count each; other columns are ignored. ``tokenizer_file`` is read
    by the driver and must be a byte-level tokenizer that changes no character, else the call
    raises ValueError.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("an overlap is no longer than a chunk")
    spec, near_end = _checked(tokenizer_file)
    shared = documents.sparkSession.sparkContext.broadcast(spec)
    own = documents.select(
        *carry,
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    names = (*carry, "n_bytes")
    schema = own.select(*names).schema.simpleString()[7:-1].replace(":", " ")
    short = own.where(F.col("n_bytes") <= long_bytes).mapInArrow(
        _counter(shared, names), schema + ", n_tokens bigint"
    )
    large = stored(
        own.where(F.col("n_bytes") > long_bytes).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "long-texts",
    )
    counts = None
    pending = large.select("row", "text")
    while not pending.isEmpty():
        spliced = _spliced(pending, shared, chunk_chars, overlap_chars, near_end)
        settled = spliced.where("n_open = 0").select("row", "n_tokens")
        counts = settled if counts is None else counts.unionByName(settled)
        pending = pending.join(spliced.where("n_open > 0"), "row", "left_semi")
        chunk_chars, overlap_chars = chunk_chars * WIDER, overlap_chars * WIDER
    every = short
    if counts is not None:
        every = short.unionByName(large.join(counts, "row").select(*names, "n_tokens"))
    return every.select(*names, "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _checked(tokenizer_file: str) -> tuple[str, int]:
    """The tokenizer's definition, and how near its end a chunk may be wrong."""
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    if (
        spec.get("normalizer")
        or cut.get("type") != "ByteLevel"
        or cut.get("add_prefix_space")
        or not cut.get("use_regex", True)
        or any(token[k] for token in added for k in ("lstrip", "rstrip", "single_word"))
    ):
        raise ValueError(f"{tokenizer_file}: not a plain byte-level tokenizer")
    # Only adds tokens and trims offsets.
    spec["post_processor"] = None
    longest = max((len(token["content"]) for token in added), default=0)
    return json.dumps(spec), longest + _AHEAD


def _loaded(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _counter(shared, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(shared.value)
        for batch in batches:
            for row, texts in words.slices(batch.column("text"), BATCH_BYTES):
                encoded = tokenizer.encode_batch_fast(
                    [text or "" for text in texts.to_pylist()], add_special_tokens=False
                )
                here = batch.slice(row, len(texts))
                n = pa.array([len(one) for one in encoded], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(here.column(name) for name in names), n], [*names, "n_tokens"]
                )

    return run


def _spliced(
    texts: DataFrame, shared, chunk_chars: int, overlap_chars: int, near_end: int
) -> DataFrame:
    """``row, n_tokens, n_open`` of ``texts(row, text)``: the tokens if all neighbouring chunks
    could be spliced, and how many could not."""
    chunks = texts.mapInArrow(
        _cutter(chunk_chars, overlap_chars), "row long, chunk int, is_last boolean, text string"
    ).repartition("row", "chunk")
    ends = stored(
        chunks.mapInArrow(
            _encoder(shared, chunk_chars, overlap_chars, near_end),
            "row long, chunk int, is_last boolean, n long, head array<int>,"
            " head_before array<int>, tail array<int>, tail_before array<int>",
        ),
        "chunk-ends",
    )
    # Positions count from the start of the later chunk.
    following = ends.select(
        "row", (F.col("chunk") - 1).alias("chunk"), "head", "head_before"
    ).where("chunk >= 0")
    at = F.array_min(F.array_intersect("tail", "head"))

    def before(side: str):
        place = F.array_position(side, F.col("at")).cast("int")
        return F.when(place > 0, F.try_element_at(f"{side}_before", place))

    joints = (
        ends.where("NOT is_last")
        .select("row", "chunk", "tail", "tail_before")
        .join(following, ["row", "chunk"])
        .withColumn("at", at)
        .select("row", (before("tail") - before("head")).cast("long").alias("n"))
    )
    return stored(
        joints.unionByName(ends.where("is_last").select("row", "n"))
        .groupBy("row")
        .agg(
            F.sum("n").alias("n_tokens"),
            F.sum(F.col("n").isNull().cast("long")).alias("n_open"),
        ),
        "spliced",
    )


def _cutter(chunk_chars: int, overlap_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                whole = text.as_py()
                for chunk, begin in enumerate(range(0, max(len(whole), 1), chunk_chars)):
                    end = begin + chunk_chars
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": [row],
                            "chunk": pa.array([chunk], pa.int32()),
                            "is_last": [end >= len(whole)],
                            "text": [whole[begin : end + overlap_chars]],
                        }
                    )

    return run


def _encoder(shared, chunk_chars: int, overlap_chars: int, near_end: int):
    """The tokens of each chunk, and the boundaries between pieces in its overlaps with the
    tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(shared.value)
        for batch in batches:
            out = {name: [] for name in ("n", "head", "head_before", "tail", "tail_before")}
            for text in batch.column("text"):
                encoded = tokenizer.encode(text.as_py(), add_special_tokens=False)
                piece = np.array(encoded.word_ids, dtype=np.int64)
                first = np.ones(len(piece), dtype=bool)
                first[1:] = piece[1:] != piece[:-1]
                before = np.flatnonzero(first)
                spans = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
                at = spans[before, 0]
                head = at < overlap_chars
                tail = (at >= chunk_chars) & (at < chunk_chars + overlap_chars - near_end)
                out["n"].append(len(piece))
                out["head"].append(at[head])
                out["head_before"].append(before[head])
                out["tail"].append(at[tail] - chunk_chars)
                out["tail_before"].append(before[tail])
            lists = [pa.array(out[k], pa.list_(pa.int32())) for k in list(out)[1:]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(out["n"], pa.int64()), *lists],
                ["row", "chunk", "is_last", *out],
            )

    return run
