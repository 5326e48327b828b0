"""Benchmark passages in documents, found by latent semantic retrieval and then confirmed.

1. The words of the benchmark passages are the features, weighted by inverse document frequency
   over all documents; repeats within a passage or window are damped by their logarithm.
2. A randomised singular value decomposition of TF-IDF passages gives the latent space. It is
   fitted on all passages of all documents and on the benchmark passages. The products with the
   passages are summed by Spark, part by part; the sum over the documents' passages is scaled
   down to the weight of the benchmark's, or the directions of a large corpus would leave none
   that tell the benchmark passages apart.
3. Every document is cut into overlapping windows sized after the benchmark passages, so that
   any copy lies wholly in one window. A window and a passage are candidates if the cosine of
   their latent vectors is at least ``least_cosine``. Windows that hold too few words of the
   benchmark, or of its rarer ones, to be confirmed for any passage are passed over before.
4. A candidate is confirmed by the longest common subsequence of words: ``copied`` of the
   passage in order; or ``paraphrased`` of it, if its answer (its last words) stands there in
   order too.

Benchmark passages are queries: they are taken in blocks of ``block_items``, each with a space of
as many directions as it has passages, and each of which reads the documents once. Their
benchmark words are written once, by passage, for all blocks. Nothing is shuffled but counts and
partial sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from skyvane.llm import words
from skyvane.llm.storage import stored

# Directions of a latent space at most, and benchmark passages that share one. With these and the
# cosine all that can be confirmed was found in copies, copies beside repeated text and paraphrases.
RANK = 64
BLOCK_ITEMS = 200
LEAST_COSINE = 0.5
POWER_ROUNDS = 2
# How often a benchmark passage counts in the fit, so that the space can tell them apart. The
# passages of all documents count once each, and less if they would outweigh the benchmark's.
ITEM_WEIGHT = 20.0
COPIED, PARAPHRASED = 0.8, 0.6
ANSWER_WORDS = 5
LEAST_WORDS = 8
CHUNK = 8
MATCH = "array<struct<item_id:bigint,cosine:double,lcs:bigint,item_words:bigint,answer_found:boolean>>"

_MATCH_TYPE = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("cosine", pa.float64()),
            ("lcs", pa.int64()),
            ("item_words", pa.int64()),
            ("answer_found", pa.bool_()),
        ]
    )
)
_BLOCK_BYTES = 1 << 20
_MARKS = 3
# Pairs of words and passages that are compared at a time, and windows that are.
_PAIRS = 1 << 20
_WINDOWS = 512
_PASSAGE_WORDS = 48


def with_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    into: str = "matches",
    least_cosine: float = LEAST_COSINE,
    block_items: int = BLOCK_ITEMS,
    rank: int = RANK,
    exact: bool = False,
) -> DataFrame:
    """``documents`` with the confirmed benchmark passages of each row, an empty list if none.

    ``benchmark(item_id, text)``: passages without words are left out; one of fewer than
    ``LEAST_WORDS`` words counts only if all of it is found in order. Words are runs of
    characters other than ASCII signs and white space, A-Z lower-cased. Every row of
    ``documents`` gives one row; a column named like ``into`` is replaced. Each match has the
    item, the cosine and longest common subsequence of its best window, the number of words of
    the item, and whether its answer was found; the list is in the order of item_id. With
    ``exact`` the cosine picks no candidates: every window with enough of a passage's words is
    confirmed, which finds all there is and is what the recall of the search is measured by.
    """
    spark = documents.sparkSession
    others = documents.drop(into)
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    queries = [
        (row.item_id, hashed)
        for row in sorted(items.collect())
        if len(hashed := _words_of(row.text))
    ]
    schema = StructType([*others.schema.fields, StructField(into, DataType.fromDDL(MATCH))])
    result = others.withColumn(into, F.array().cast(MATCH))
    if not queries:
        return result
    vocabulary = np.unique(np.concatenate([hashed for _, hashed in queries]))
    passages = _passages(documents, vocabulary)
    idf = _inverse_frequency(passages, len(vocabulary))
    for begin in range(0, len(queries), block_items):
        own = queries[begin : begin + block_items]
        known = np.unique(np.concatenate([hashed for _, hashed in own]))
        place = np.searchsorted(vocabulary, known)
        space = _latent_basis(passages, own, known, place, idf, min(rank, len(own), len(known)))
        weights = idf[place]
        shared = spark.sparkContext.broadcast(
            (own, known, (space * weights[:, None]).astype(np.float32), weights)
        )
        limit = None if exact else least_cosine
        result = result.mapInArrow(_searcher(shared, limit, result.columns, into), schema)
    return result


def _words_of(text: str) -> np.ndarray:
    return words.Block(pa.array([text]), 0, words.SIGNS).hashes()


def _numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word in ``known``, or -1."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def _passages(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The passages of all documents, a row for each document: the number of each distinct
    benchmark word of a passage, how often it stands there, and how many each passage has.
    Passages without such a word are left out, documents without one are not."""
    size = len(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text"), separators=words.SIGNS):
                number = _numbers(shared.value, block.hashes())
                first = np.concatenate([[0], np.cumsum(-(-block.counts() // _PASSAGE_WORDS))])
                text = np.repeat(np.arange(block.n_texts), block.counts())
                passage = first[text] + (np.arange(len(text)) - block.first[text]) // _PASSAGE_WORDS
                known = number >= 0
                cell, times = np.unique(
                    passage[known] * np.int64(size) + number[known], return_counts=True
                )
                sizes = np.bincount(cell // size, minlength=first[-1])
                begins = np.concatenate([[0], np.cumsum(sizes)])[first]
                used = np.concatenate([[0], np.cumsum(sizes > 0)])[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        _binaries((cell % size).astype(np.int32), begins),
                        _binaries(times.astype(np.uint8), begins),
                        _binaries(sizes[sizes > 0].astype(np.uint8), used),
                    ],
                    ["features", "times", "sizes"],
                )

    schema = "features binary, times binary, sizes binary"
    return stored(documents.select("text").mapInArrow(run, schema), "passages")


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of the values from each place of ``first`` to the next."""
    offsets = (first * values.itemsize).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, buffers).cast(pa.binary())


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binaries`` was given."""
    column = column.cast(pa.large_binary())
    _, bounds, content = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _inverse_frequency(passages: DataFrame, size: int) -> np.ndarray:
    """By the number of documents with each word of the benchmark, counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for _, part in words.slices(batch.column("features"), _BLOCK_BYTES):
                feature, first = _values(part, np.int32)
                text = np.repeat(np.arange(len(part)), np.diff(first))
                cell = np.unique(text * np.int64(size) + feature)
                total[:size] += np.bincount(cell % size, minlength=size)
                total[size] += len(part)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[used])], ["feature", "n"]
        )

    counted = (
        passages.select("features")
        .mapInArrow(run, "feature long, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    total = np.zeros(size + 1)
    for row in counted:
        total[row.feature] = row.n
    return np.log((total[size] + 1) / (total[:size] + 1)) + 1e-3


def _latent_basis(
    passages: DataFrame,
    queries: list[tuple[int, np.ndarray]],
    known: np.ndarray,
    place: np.ndarray,
    idf: np.ndarray,
    rank: int,
) -> np.ndarray:
    """Orthonormal directions (words by rank) of the largest singular values of the passages and
    the queries; ``place`` has the number of each known word among those of the passages. The
    passages with a known word weigh together at most as much as the queries."""
    weights = idf[place]
    local = np.full(len(idf), -1, dtype=np.int64)
    local[place] = np.arange(len(place))
    group = np.repeat(np.arange(len(queries)), [len(hashed) for _, hashed in queries])
    number = np.concatenate([_numbers(known, hashed) for _, hashed in queries])
    own = _damped(group, number, len(known))
    drawn = np.random.Generator(np.random.PCG64(11))
    basis = _orthonormal(drawn.standard_normal((len(known), rank), dtype=np.float32))
    spark = passages.sparkSession
    for _ in range(POWER_ROUNDS):
        shared = spark.sparkContext.broadcast((basis, weights, local))
        parts = (
            passages.mapInArrow(_products(shared), "slot int, part binary, n long")
            .groupBy("slot")
            .applyInArrow(_summed, "slot int, part binary, n long")
            .toArrow()
        )
        product = np.zeros(basis.shape, dtype=np.float32)
        _add_product(product, *own, basis, weights)
        product *= ITEM_WEIGHT
        n = max(parts.column("n").to_pylist(), default=0)
        scale = np.float32(min(1.0, ITEM_WEIGHT * len(queries) / max(n, 1)))
        size = -(-len(known) // _SLOTS)
        for slot, part in zip(parts.column("slot").to_pylist(), parts.column("part")):
            product[slot * size : (slot + 1) * size] += scale * np.frombuffer(
                part.as_buffer(), dtype=np.float32
            ).reshape(-1, rank)
        shared.destroy()
        basis = _orthonormal(product)
    return basis


def _orthonormal(product: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``product``, from their small Gram matrix, so that
    no second matrix of this size is held beside the two. Directions that are lost in rounding
    give columns of zeros."""
    gram = np.zeros((product.shape[1], product.shape[1]))
    for at in range(0, len(product), 4096):
        part = product[at : at + 4096].astype(float)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-10 * max(values.max(), 1e-300)
    scale = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
    return product @ (vectors * scale).astype(np.float32)


# Parts that a product is summed in, and passages that are multiplied at a time.
_SLOTS = 64
_PASSAGES = 250


def _damped(group: np.ndarray, number: np.ndarray, size: int):
    """Group, number and damped count of the distinct numbers of each group, in that order."""
    cell, n = np.unique(group * np.int64(size) + number, return_counts=True)
    return cell // size, cell % size, 1 + np.log(n)


def _add_product(
    total: np.ndarray,
    passage: np.ndarray,
    feature: np.ndarray,
    value: np.ndarray,
    basis: np.ndarray,
    weights: np.ndarray,
) -> int:
    """Add to ``total`` each passage's unit TF-IDF vector times its product with the basis, and
    tell the number of passages. ``value`` has the damped count of each feature of a passage;
    those of a passage stand together."""
    if not len(passage):
        return 0
    value = value * weights[feature]
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    sizes = np.diff(begins, append=len(passage))
    norm = np.maximum(np.sqrt(np.add.reduceat(value * value, begins)), 1e-12)
    value = (value / np.repeat(norm, sizes)).astype(np.float32)
    image = np.add.reduceat(basis[feature] * value[:, None], begins)
    order = np.argsort(feature, kind="stable")
    row = np.repeat(np.arange(len(begins)), sizes)[order]
    feature = feature[order]
    first = np.flatnonzero(np.diff(feature, prepend=-1))
    total[feature[first]] += np.add.reduceat(image[row] * value[order][:, None], first)
    return len(begins)


def _products(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, weights, local = shared.value
        total = np.zeros(basis.shape, dtype=np.float32)
        n = 0
        for batch in batches:
            for row, part in words.slices(batch.column("features"), _BLOCK_BYTES):
                feature = local[_values(part, np.int32)[0]]
                times, _ = _values(batch.column("times").slice(row, len(part)), np.uint8)
                sizes, _ = _values(batch.column("sizes").slice(row, len(part)), np.uint8)
                value = 1 + np.log(times.astype(float))
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for at in range(0, len(sizes), _PASSAGES):
                    own = sizes[at : at + _PASSAGES]
                    held = slice(ends[at], ends[at + len(own)])
                    known = feature[held] >= 0
                    n += _add_product(
                        total,
                        np.repeat(np.arange(len(own)), own)[known],
                        feature[held][known],
                        value[held][known],
                        basis,
                        weights,
                    )
        size = -(-len(basis) // _SLOTS)
        parts = [total[k * size : (k + 1) * size].tobytes() for k in range(_SLOTS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(_SLOTS, dtype=np.int32)),
                pa.array(parts, pa.binary()),
                pa.array(np.full(_SLOTS, n)),
            ],
            ["slot", "part", "n"],
        )

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_buffer(), dtype=np.float32) for p in group.column("part"))
    return pa.table(
        {
            "slot": pa.array([group.column("slot")[0].as_py()], pa.int32()),
            "part": pa.array([total.tobytes()], pa.binary()),
            "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()),
        }
    )


class Queries:
    """Benchmark passages by the size of window that they are looked for with.

    Words are numbered from 1 by their place in ``words``; ``space`` has the latent vector of
    each. A window that is to share enough words with a passage must hold ``_MARKS`` words from
    among the passage's rarest: those that make up ``_MARKS`` places more than may be missing.
    ``is_mark`` tells for each size which words are such a mark of some passage.
    """

    def __init__(
        self,
        queries: list[tuple[int, np.ndarray]],
        known: np.ndarray,
        space: np.ndarray,
        weights: np.ndarray,
    ):
        self.ids = [item for item, _ in queries]
        self.hashes = [hashed for _, hashed in queries]
        self.counts = [Counter(hashed.tolist()) for hashed in self.hashes]
        self.words = known
        # A first row of zeros stands for no word.
        self.space = np.vstack([np.zeros((1, space.shape[1]), dtype=space.dtype), space])
        weight_of = dict(zip(known.tolist(), weights.tolist()))
        rarest = []
        for row, counts in enumerate(self.counts):
            spare = len(self.hashes[row]) - self.needed(row) + min(_MARKS, self.needed(row))
            own = []
            for code in sorted(counts, key=lambda c: (-weight_of[c], c)):
                if spare <= 0:
                    break
                own.append(code)
                spare -= counts[code]
            rarest.append(own)
        self.has = np.zeros((len(queries), len(self.words) + 1), dtype=bool)
        for row, counts in enumerate(self.counts):
            self.has[row, self.numbers(counts)] = True
        self.rarest = [self.numbers(own) for own in rarest]
        self.least_words = np.array([self.needed(k) for k in range(len(queries))])
        self.least_marks = np.array([min(_MARKS, self.needed(k)) for k in range(len(queries))])
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.is_mark: dict[int, np.ndarray] = {}
        level_of = [
            max(0, int(np.ceil(np.log2(max(len(h), 1) / (2 * CHUNK))))) for h in self.hashes
        ]
        for level in sorted(set(level_of)):
            rows = np.array([k for k, own in enumerate(level_of) if own == level])
            longest = max(len(self.hashes[k]) for k in rows)
            held = np.zeros((len(rows), longest), dtype=np.int64)
            for at, k in enumerate(rows):
                held[at, : len(self.hashes[k])] = self.numbers(self.hashes[k])
            self.levels[level] = rows, _unit(self.vectors(held))
            self.is_mark[level] = np.zeros(len(self.words) + 1, dtype=bool)
            self.is_mark[level][np.concatenate([self.rarest[k] for k in rows])] = True

    def numbers(self, codes) -> np.ndarray:
        return np.searchsorted(self.words, np.array(list(codes), dtype=np.uint64)) + 1

    def vectors(self, held: np.ndarray) -> np.ndarray:
        """The latent vector of each row of ``held``, numbers of words or 0."""
        out = np.zeros((len(held), self.space.shape[1]), dtype=np.float32)
        row, at = np.nonzero(held)
        if len(row):
            row, number, value = _damped(row, held[row, at], len(self.space))
            used, first = np.unique(row, return_index=True)
            parts = self.space[number] * value.astype(np.float32)[:, None]
            out[used] = np.add.reduceat(parts, first)
        return out

    def near(self, level: int, held: np.ndarray, least: float):
        """Windows, places in ``levels[level]`` and cosines of pairs of at least that cosine."""
        cosines = _unit(self.vectors(held)) @ self.levels[level][1].T
        w, q = np.nonzero(cosines >= least)
        return w, q, cosines[w, q]

    def possible(self, level: int, held: np.ndarray):
        """The same for all pairs with enough words in common for a confirmation."""
        rows, vectors = self.levels[level]
        w, q = np.divmod(np.arange(len(held) * len(rows)), len(rows))
        enough = np.zeros(len(w), dtype=bool)
        step = max(1, _PAIRS // held.shape[1])
        for at in range(0, len(w), step):
            own, other = w[at : at + step], rows[q[at : at + step]]
            shared = np.count_nonzero(self.has[other[:, None], held[own]], axis=1)
            enough[at : at + step] = shared >= self.least_words[other]
        w, q = w[enough], q[enough]
        return w, q, (_unit(self.vectors(held)) @ vectors.T)[w, q]

    def needed(self, row: int) -> int:
        n = len(self.hashes[row])
        return n if n < LEAST_WORDS else int(np.ceil(min(PARAPHRASED, COPIED) * n - 1e-9))

    def confirmed(self, row: int, window: np.ndarray) -> tuple[int, bool] | None:
        """Common subsequence, and whether the answer is in the window; None if too little."""
        item = self.hashes[row]
        need = self.needed(row)
        counts = self.counts[row]
        held = Counter(h for h in window.tolist() if h in counts)
        if sum(min(n, counts[h]) for h, n in held.items()) < need:
            return None
        common = common_subsequence(item, window)
        answer = item[-ANSWER_WORDS:]
        found = common_subsequence(answer, window) == len(answer)
        enough = len(item) if len(item) < LEAST_WORDS else np.ceil(COPIED * len(item) - 1e-9)
        if common >= enough or (common >= need and found):
            return common, found
        return None


def common_subsequence(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits."""
    places: dict[int, int] = {}
    for at, code in enumerate(one.tolist()):
        places[code] = places.get(code, 0) | (1 << at)
    every = (1 << len(one)) - 1
    row = every
    for code in two.tolist():
        hit = row & places.get(code, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & every
    return len(one) - row.bit_count()


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-9)


def _searcher(shared, least_cosine: float | None, names: list[str], into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*shared.value)
        for batch in batches:
            before = batch.column(into)
            found: list[list[dict]] = []
            for block in words.blocks(batch.column("text"), _BLOCK_BYTES, words.SIGNS):
                found.extend(_found(block, queries, least_cosine))
            merged = [
                sorted(old + new, key=lambda m: m["item_id"])
                for old, new in zip(before.to_pylist(), found)
            ]
            columns = [batch.column(name) for name in names if name != into]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(merged, _MATCH_TYPE)],
                [*(name for name in names if name != into), into],
            )

    return run


def _found(block: words.Block, queries: Queries, least_cosine: float | None) -> list[list[dict]]:
    """Matches of each text of the block."""
    best: list[dict[int, tuple]] = [{} for _ in range(block.n_texts)]
    hashes = block.hashes()
    n_words = block.counts()
    # Texts are padded to whole chunks of words, so a chunk never crosses the end of a text.
    n_chunks = -(-n_words // CHUNK)
    chunk_first = np.concatenate([[0], np.cumsum(n_chunks)])
    text_of = np.repeat(np.arange(block.n_texts), n_chunks)
    place = np.arange(chunk_first[-1]) - chunk_first[text_of]
    begins = block.first[text_of] + place * CHUNK
    text_of_word = np.repeat(np.arange(block.n_texts), n_words)
    spot = np.arange(len(hashes)) + (chunk_first[:-1] * CHUNK - block.first[:-1])[text_of_word]
    mark = np.zeros(len(begins) * CHUNK, dtype=np.int32)
    mark[spot] = _numbers(queries.words, hashes) + 1
    marks = mark.reshape(-1, CHUNK)
    level = 0
    for wanted in sorted(queries.levels):
        while level < wanted:  # two chunks become one
            first = np.flatnonzero(place % 2 == 0)
            paired = place[first] + 1 < n_chunks[text_of[first]]
            other = first[paired] + 1
            new_marks = np.zeros((len(first), 2 * marks.shape[1]), np.int32)
            new_marks[:, : marks.shape[1]] = marks[first]
            new_marks[paired, marks.shape[1] :] = marks[other]
            marks = new_marks
            text_of, place, begins = text_of[first], place[first] // 2, begins[first]
            n_chunks = -(-n_chunks // 2)
            level += 1
        size = CHUNK << level
        rows = queries.levels[wanted][0]
        # Words of the benchmark, and marks, in each chunk; a window is three chunks, or as many
        # as the text has. Most windows have too few of any passage.
        starts = np.flatnonzero(place < np.maximum(n_chunks - 2, 1)[text_of])
        n_known = np.count_nonzero(marks, axis=1)
        n_marks = np.count_nonzero(queries.is_mark[wanted][marks], axis=1)
        chunks = np.stack([starts, starts + 1, starts + 2], axis=1)
        inside = place[starts][:, None] + np.arange(3) < n_chunks[text_of[starts]][:, None]
        chunks = np.where(inside, chunks, 0)
        enough = (n_known[chunks] * inside).sum(axis=1) >= queries.least_words[rows].min()
        enough &= (n_marks[chunks] * inside).sum(axis=1) >= queries.least_marks[rows].min()
        starts, chunks, inside = starts[enough], chunks[enough], inside[enough]
        for at in range(0, len(starts), _WINDOWS):
            held = marks[chunks[at : at + _WINDOWS]] * inside[at : at + _WINDOWS, :, None]
            held = held.reshape(len(held), -1)
            if least_cosine is None:
                pairs = queries.possible(wanted, held)
            else:
                pairs = queries.near(wanted, held, least_cosine)
            for w, q, cosine in zip(*(own.tolist() for own in pairs)):
                start = starts[at + w]
                text, row = int(text_of[start]), int(rows[q])
                begin = begins[start]
                own = hashes[begin : min(begin + 3 * size, block.first[text + 1])]
                confirmed = queries.confirmed(row, own)
                if confirmed is not None:
                    new = (confirmed[0], cosine, confirmed[1])
                    best[text][row] = max(best[text].get(row, new), new)
    return [
        [
            {
                "item_id": queries.ids[row],
                "cosine": cosine,
                "lcs": common,
                "item_words": len(queries.hashes[row]),
                "answer_found": answer,
            }
            for row, (common, cosine, answer) in sorted(own.items())
        ]
        for own in best
    ]
