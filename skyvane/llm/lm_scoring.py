"""Language-model scores of texts by a weighted backoff automaton.

Every word sequence of up to ``order`` words of the training texts is part of the automaton. Its
states are the sequences that can precede a word; an arc reads a word and leads on; where a state
has no arc for the word, its failure arc leads to the sequence without its first word. Arcs and
failure arcs carry log probabilities of counts that are smoothed by the shorter sequence:

    P(w | h) = (count(h w) + strength * P(w | shorter h)) / (count(h) + strength)

and at the root the add-one probability. A text is read once from left to right: its state is
carried from word to word and the weights on the way are summed.

Texts are put together in blocks. A block names each distinct sequence it holds once, by a 64-bit
hash, with how often its training texts hold it; the names are dealt out by range, added up, and
the totals sent back in the order they were asked for. So the automaton of a block, which is
all of the whole one that its texts can meet, is built in place, from sorted arrays. What travels is
packed: sorted names as differences, their bytes by planes, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.llm import words
from skyvane.llm.storage import bucketed, stored

ORDER = 3
STRENGTH = 4.0
# Tokens of a block; distinct sequences, counted once per block, that are added up together.
BLOCK_TOKENS = 1_500_000
SHARE_NAMES = 2_000_000
# Bytes of text that are cut into words at a time.
SLICE_BYTES = 1 << 20
# Words of a text that are read one after another; the pieces of a block are read side by side.
PIECE = 1024

# The end of a text and its start, in place of a word's hash.
END, START = 0, 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lm_scores(
    documents: DataFrame,
    training: DataFrame | Column,
    order: int = ORDER,
    strength: float = STRENGTH,
    carry: tuple[str, ...] = ("doc_id",),
    block_tokens: int = BLOCK_TOKENS,
    share_names: int = SHARE_NAMES,
) -> DataFrame:
    """The columns ``carry`` and ``n_tokens, n_known, train_tokens, base_score, score`` per row
    of ``documents``, learnt from ``training``: another table, or a condition that picks rows
    of ``documents``, which is cheaper. Both have ``text``, where null is empty.

    Tokens are the runs of anything but ASCII white space, A-Z lower-cased, and one end per
    text. ``base_score`` is the add-one unigram log10 probability, ``score`` that of the
    automaton. Without training texts every token has probability 1. Rows that repeat are scored
    each; other columns are ignored. Nothing is dropped: a sequence seen once has its arc.
    """
    kinds = documents.select(*carry).schema
    learns = training if isinstance(training, Column) else F.lit(False)
    own = documents.select(
        *carry,
        "text",
        F.lit(True).alias("scored"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
    )
    if not isinstance(training, Column):
        own = own.unionByName(
            training.select("text", F.lit(False).alias("scored"), F.lit(True).alias("learns")),
            allowMissingColumns=True,
        )
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields]
    packed = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in kinds.fields]
    packed += ["scored array<boolean>", "learns array<boolean>", "n_words array<int>"]
    packed += ["known_words binary", "places binary", "n_learnt long"]
    blocks = bucketed(
        own.mapInArrow(_blocks(carry, block_tokens), ", ".join(packed)).withColumn(
            "block", F.monotonically_increasing_id()
        ),
        "blocks",
        "block",
    )
    n, n_places = blocks.agg(
        F.coalesce(F.sum("n_learnt"), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)),
    ).first()
    shares = max(order * n_places // share_names, 1)
    answers = stored(
        blocks.select("block", "learns", "n_words", "known_words", "places")
        .mapInArrow(
            _named(order, shares),
            "share int, block long, length int, names binary, counts binary",
        )
        .groupBy("share")
        .applyInArrow(
            _added_up, "share int, block long, length int, totals binary, n_distinct long"
        ),
        "totals",
    )
    v = answers.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    figures = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = ", ".join([*carried, figures])
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_scored(carry, order, strength, n, v), schema)
    )


# Blocks of texts, as the numbers of their words.


def _blocks(carry: tuple[str, ...], block_tokens: int):
    """Rows of texts as one row of lists: the hashes of the words they use, the most frequent
    first, and for each place the number of its word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def emitted() -> pa.RecordBatch:
            rows = pa.Table.from_batches([batch for batch, _, _ in held])
            hashes = np.concatenate([hashes for _, hashes, _ in held])
            known, places, n = np.unique(hashes, return_inverse=True, return_counts=True)
            falling = np.argsort(-n, kind="stable")
            number = np.empty(len(known), dtype=np.uint64)
            number[falling] = np.arange(len(known), dtype=np.uint64)
            n_words = np.concatenate([counts for _, _, counts in held])
            learns = rows.column("learns").to_numpy()
            columns = [*carry, "scored", "learns"]
            one = pa.array([0, len(rows)], pa.int32())
            lists = [
                pa.ListArray.from_arrays(one, rows.column(name).combine_chunks()) for name in columns
            ]
            return pa.RecordBatch.from_arrays(
                [
                    *lists,
                    pa.ListArray.from_arrays(one, pa.array(n_words.astype(np.int32))),
                    pa.array([_packed(known[falling])], pa.binary()),
                    pa.array([_packed(number[places])], pa.binary()),
                    pa.array([int((n_words[learns] + 1).sum())], pa.int64()),
                ],
                [*columns, "n_words", "known_words", "places", "n_learnt"],
            )

        size = 0
        for batch in batches:
            for block in words.blocks(batch.column("text"), SLICE_BYTES):
                rows = batch.slice(block.row, block.n_texts).select([*carry, "scored", "learns"])
                held.append((rows, block.hashes(), block.counts()))
                size += len(block.starts) + block.n_texts
                if size >= block_tokens:
                    yield emitted()
                    held, size = [], 0
        if held:
            yield emitted()

    return run


class _Places:
    """The words and ends of a block's texts, each text behind its start."""

    def __init__(self, known_words: bytes, places: bytes, n_words: np.ndarray):
        known = _unpacked(known_words)
        self.end, self.start = len(known), len(known) + 1
        self.hashes = np.concatenate([known, np.array([END, START], dtype=np.uint64)])
        self.n_words = n_words.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 2)])
        n_texts = len(n_words)
        self.text = np.repeat(np.arange(n_texts, dtype=np.int32), self.n_words + 2)
        self.word = np.full(self.first[-1], self.end, dtype=np.int32)
        self.word[self.first[:-1]] = self.start
        is_word = np.ones(self.first[-1], dtype=bool)
        is_word[self.first[:-1]] = False
        is_word[self.first[1:] - 1] = False
        self.word[is_word] = _unpacked(places).astype(np.int32)

    def names(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the names of the sequences of that many words that end at each place,
        and which places have one."""
        own = self.hashes[self.word]
        since = np.arange(len(own)) - self.first[self.text]
        name = np.zeros(len(own), dtype=np.uint64)
        for length in range(1, order + 1):
            if length > 1:
                name = np.concatenate([name[:1], name[:-1]])  # of the words before
            name = words.mixed((name + np.uint64(length)) * _SPREAD + own)
            yield length, name, since >= length - 1


def _bounds(shares: int) -> np.ndarray:
    return np.array([(k << 64) // shares for k in range(1, shares)], dtype=np.uint64)


def _named(order: int, shares: int):
    """The distinct sequences of each block with how often its training texts hold them, one
    row for each length and share of the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(shares)
        for batch in batches:
            for row in range(len(batch)):
                block, learns, n_words, known_words, places = (
                    batch.column(k)[row] for k in range(5)
                )
                own = _Places(
                    known_words.as_py(), places.as_py(), np.asarray(n_words.values)
                )
                learnt = learns.values.to_numpy(zero_copy_only=False)[own.text]
                for length, name, there in own.names(order):
                    distinct, inverse = np.unique(name[there], return_inverse=True)
                    n = np.bincount(inverse, learnt[there], len(distinct)).astype(np.uint64)
                    cuts = [0, *np.searchsorted(distinct, bounds).tolist(), len(distinct)]
                    rows = [
                        (share, _packed_rising(distinct[a:b]), _packed(n[a:b]))
                        for share, (a, b) in enumerate(zip(cuts, cuts[1:]))
                        if b > a
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([share for share, _, _ in rows], pa.int32()),
                            pa.array([block.as_py()] * len(rows), pa.int64()),
                            pa.array([length] * len(rows), pa.int32()),
                            pa.array([names for _, names, _ in rows], pa.binary()),
                            pa.array([counts for _, _, counts in rows], pa.binary()),
                        ],
                        ["share", "block", "length", "names", "counts"],
                    )

    return run


def _added_up(lists: pa.Table) -> pa.Table:
    """The total of each name of a share, in the order of every list that has it; and how many
    words, without the start of a text, have one at all."""
    names = [_unpacked_rising(one.as_py()) for one in lists.column("names")]
    counts = [_unpacked(one.as_py()) for one in lists.column("counts")]
    ends = np.cumsum([len(one) for one in names])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    sums = np.add.reduceat(np.concatenate(counts)[order], begins)
    totals = np.empty(len(every), dtype=np.uint64)
    totals[order] = np.repeat(sums, np.diff(np.append(begins, len(ranked))))
    parts = np.split(totals, ends[:-1])
    lengths = lists.column("length").to_numpy()
    single = np.repeat(lengths == 1, np.diff(np.concatenate([[0], ends])))
    start = words.mixed((np.zeros(1, np.uint64) + np.uint64(1)) * _SPREAD + np.uint64(START))[0]
    known = np.unique(every[single & (totals > 0) & (every != start)])
    n_distinct = np.zeros(len(parts), dtype=np.int64)
    n_distinct[0] = len(known)
    return pa.table(
        {
            "share": lists.column("share"),
            "block": lists.column("block"),
            "length": lists.column("length"),
            "totals": pa.array([_packed(part) for part in parts], pa.binary()),
            "n_distinct": pa.array(n_distinct),
        }
    )


# The automaton of a block.


def _ranked(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct name, in the order of names, and the rank of the name at each
    place."""
    order = np.argsort(names)
    ordered = names[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(names), dtype=np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], rank


class Automaton:
    """States with arcs by word, failure arcs and their weights, all sorted arrays."""

    def __init__(self, own: _Places, totals: list[np.ndarray], order: int, strength: float, n, v):
        self.n_words = len(own.hashes)
        self.unseen = -np.log10(float(n + v + 1))
        self.root = 0
        size = sum(int(np.count_nonzero(total)) for total in totals)
        # Longer states have larger numbers, so the arcs of each length follow those before.
        self.codes = np.empty(size, dtype=np.int64)
        self.next = np.empty(size, dtype=np.int32)
        self.weight = np.empty(size)
        fails, fail_weights = [np.zeros(1, np.int32)], [np.zeros(1)]
        at_place = np.zeros(len(own.word), dtype=np.int32)  # the state of the words before
        done, base = 0, 1  # arcs that are there, and the number of the next state
        self.single = np.zeros(0)
        for length, name, there in own.names(order):
            count = totals[length - 1].astype(np.float64)
            # Which sequence of this length ends at each place, and a place of each sequence.
            number = np.zeros(len(own.word), dtype=np.int32)
            first, number[there] = _ranked(name[there])
            place = np.flatnonzero(there)[first]
            if length == 1:
                chance = (count + 1) / (n + v + 1)
                self.single = count[number]
            else:
                history = counts[numbers[place - 1]]
                chance = (count + strength * chances[numbers[place]]) / (history + strength)
            seen = np.flatnonzero(count > 0)
            here = place[seen]
            code = self._code(at_place[here - 1] if length > 1 else 0, own.word[here])
            rising = np.argsort(code)
            arcs = slice(done, done + len(seen))
            self.codes[arcs] = code[rising]
            self.weight[arcs] = np.log10(chance[seen[rising]])
            done += len(seen)
            if length < order:
                self.next[arcs] = base + seen[rising]
                fails.append(np.zeros(len(first), np.int32) if length == 1 else at_place[place])
                fail_weights.append(np.log10(strength / (count + strength)))
                at_place = np.int32(base) + number
                base += len(first)
            else:
                self.next[arcs] = at_place[here[rising]] if length > 1 else 0
            numbers, counts, chances = number, count, chance
        self.fail, self.fail_weight = np.concatenate(fails), np.concatenate(fail_weights)

    def _code(self, state, word: np.ndarray) -> np.ndarray:
        return state * np.int64(self.n_words) + word

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading one word each, and the log10 probabilities of the words."""
        state, total = state.copy(), np.zeros(len(state))
        pending = np.arange(len(state))
        while len(pending):
            code = self._code(state[pending], word[pending])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
            arc = at[found]
            total[pending[found]] += self.weight[arc]
            state[pending[found]] = self.next[arc]
            pending = pending[~found]
            stuck = state[pending] == self.root
            total[pending[stuck]] += self.unseen
            pending = pending[~stuck]
            total[pending] += self.fail_weight[state[pending]]
            state[pending] = self.fail[state[pending]]
        return state, total

    def walk(self, own: _Places, order: int, piece: int = PIECE) -> np.ndarray:
        """The log10 probability of each text. Pieces of texts are read side by side; one that
        starts within a text first reads the words before it that its state can depend on."""
        n_read = own.n_words + 1  # words and the end; the start is only a state
        pieces = -(-n_read // piece)
        text = np.repeat(np.arange(len(n_read)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = own.first[text] + 1 + nth * piece
        length = np.minimum(n_read[text] - nth * piece, piece)
        ahead = np.minimum(order - 1, begin - own.first[text])
        steps = length + ahead
        falling = np.argsort(-steps, kind="stable")
        begin, ahead, steps, text = ((x[falling]) for x in (begin, ahead, steps, text))
        at = begin - ahead
        state, sums = np.full(len(at), self.root, dtype=np.int64), np.zeros(len(at))
        for step in range(int(steps.max(initial=0))):
            m = int(np.searchsorted(-steps, -step, side="left"))
            state[:m], gained = self.read(state[:m], own.word[at[:m] + step])
            sums[:m] += np.where(step >= ahead[:m], gained, 0.0)
        return np.bincount(text, sums, len(n_read))


def _scored(carry: tuple[str, ...], order: int, strength: float, n: int, v: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = [*carry, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        row = {name: block.column(name)[0] for name in block.column_names}
        own = _Places(
            row["known_words"].as_py(), row["places"].as_py(), np.asarray(row["n_words"].values)
        )
        answers = answers.sort_by([("length", "ascending"), ("share", "ascending")])
        totals = [[] for _ in range(order)]
        for length, part in zip(answers.column("length").to_pylist(), answers.column("totals")):
            totals[length - 1].append(_unpacked(part.as_py()))
        totals = [np.concatenate(parts or [np.zeros(0, np.uint64)]) for parts in totals]
        automaton = Automaton(own, totals, order, strength, n, v)
        score = automaton.walk(own, order)
        is_token = own.word != own.start
        text, single = own.text[is_token], automaton.single[is_token]
        n_texts = len(own.n_words)
        base = np.bincount(text, np.log10((single + 1) / (n + v + 1)), n_texts)
        known = np.bincount(text, single > 0, n_texts)
        columns = [
            *(row[name].values for name in carry),
            pa.array(own.n_words + 1),
            pa.array(known.astype(np.int64)),
            pa.array(np.full(n_texts, n, dtype=np.int64)),
            pa.array(base),
            pa.array(score),
        ]
        return pa.table(columns, names).filter(row["scored"].values)

    return run


# Numbers as few bytes: the planes of bytes that the largest one needs, each compressed.


def _packed(numbers: np.ndarray) -> bytes:
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    if not len(numbers):
        return bytes(4)
    width = max((int(numbers.max()).bit_length() + 7) // 8, 1)
    codec = pa.Codec("zstd", 1)
    bytes_of = numbers.view(np.uint8).reshape(-1, 8)
    planes = [codec.compress(bytes_of[:, k].tobytes(), asbytes=True) for k in range(width)]
    head = np.array([len(numbers), width, *map(len, planes)], "<u4")
    return head.tobytes() + b"".join(planes)


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:4], "<u4")[0])
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width = int(np.frombuffer(data[4:8], "<u4")[0])
    sizes = np.frombuffer(data[8 : 8 + 4 * width], "<u4").tolist()
    out, at, codec = np.zeros((n, 8), dtype=np.uint8), 8 + 4 * width, pa.Codec("zstd")
    for k, size in enumerate(sizes):
        plane = codec.decompress(data[at : at + size], n, asbytes=True)
        out[:, k] = np.frombuffer(plane, np.uint8)
        at += size
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _packed_rising(numbers: np.ndarray) -> bytes:
    return numbers[:1].astype("<u8").tobytes() + _packed(np.diff(numbers))


def _unpacked_rising(data: bytes) -> np.ndarray:
    steps = _unpacked(data[8:])
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], "<u8"), steps]), dtype=np.uint64)
