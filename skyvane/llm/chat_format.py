"""Chat text from conversation turns, put together byte by byte in columns.

A turn becomes ``### role: text</turn>`` and a line break. Inside texts and roles the bytes
``\\``, ``#`` and ``<`` (in roles also ``:``) get a backslash in front, so no control string can
occur there and the text can be read back exactly. The bytes of a batch are placed in one
preallocated Arrow buffer: lengths and escapes give running offsets, and those give the index
that each byte is scattered to.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any size is spread
over tasks and comes back as consecutive pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.llm import words

HEAD, BETWEEN, TAIL = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
PIECE_BYTES = 4 << 20
# Bytes of an open conversation that a task holds before it lets them travel.
HELD_BYTES = 64 << 20

_BACKSLASH, _COLON, _TURN_END = 92, 58, 60
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[[_BACKSLASH, 35, _TURN_END]] = True
_STEP = 1 << 20

_PIECES = (
    "conv_id bigint, part int, seq bigint, formatted string,"
    " spans array<struct<begin:bigint,end:bigint>>"
)
_DIGESTS = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)
_DIGEST_NAMES = [field.split()[0] for field in _DIGESTS.split(", ")]


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, seq, formatted, spans``: pieces of formatted conversations.

    The pieces of a conversation, joined in the order of (part, seq), are its chat text.
    ``spans`` are the byte ranges of a piece that the loss is taken over, the texts of the
    assistant. Turns go by ``turn``, then role and text; nulls come first. Null texts and roles
    are empty; turns without conv_id are one conversation. Repeated rows are repeated turns;
    columns other than conv_id, turn, role and text are ignored.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    start = F.substring("text", 1, 64)
    ordered = turns.repartitionByRange("conv_id", "turn", "role", start).sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )
    return ordered.mapInArrow(_assembled, _PIECES)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for row, texts in words.slices(batch.column("text"), PIECE_BYTES):
            ids = batch.column("conv_id").slice(row, len(texts))
            roles = batch.column("role").slice(row, len(texts)).to_pylist()
            buffer, ends, spans = assemble(roles, texts)
            numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(len(texts), dtype=bool)
            new[1:] = (numbers[1:] != numbers[:-1]) | (missing[1:] != missing[:-1])
            first = np.flatnonzero(new)
            cuts = np.append(first, len(texts))
            offsets = np.concatenate([[0], ends])[cuts]
            own_spans = [
                [
                    {"begin": int(b - offsets[k]), "end": int(e - offsets[k])}
                    for (b, e), role in zip(spans[cuts[k] : cuts[k + 1]], roles[cuts[k] : cuts[k + 1]])
                    if role == LOSS_ROLE
                ]
                for k in range(len(first))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first)),
                    pa.array(np.full(len(first), part, dtype=np.int32)),
                    pa.array(np.arange(seq, seq + len(first))),
                    pa.StringArray.from_buffers(
                        len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer)
                    ),
                    pa.array(
                        own_spans,
                        pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["conv_id", "part", "seq", "formatted", "spans"],
            )
            seq += len(first)


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """The chat bytes of all turns, the end of each turn, and the range of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, bounds, content = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    escapes = np.flatnonzero(_ESCAPED[data])
    escapes_before = np.searchsorted(escapes, offsets)
    head_of = {role: HEAD + _escaped_role(role) + BETWEEN for role in set(roles)}
    heads = [head_of[role] for role in roles]
    head_lengths = np.array([len(h) for h in heads], dtype=np.int64)
    text_lengths = np.diff(offsets) + np.diff(escapes_before)
    ends = np.cumsum(head_lengths + text_lengths + len(TAIL))
    tail_at = ends - len(TAIL)
    text_at = tail_at - text_lengths
    head_at = text_at - head_lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    head_data = np.frombuffer(b"".join(heads), dtype=np.uint8)
    shift = head_at - (np.cumsum(head_lengths) - head_lengths)
    out[np.arange(len(head_data)) + np.repeat(shift, head_lengths)] = head_data
    out[tail_at[:, None] + np.arange(len(TAIL))] = np.frombuffer(TAIL, dtype=np.uint8)
    shift = text_at - offsets[:-1] - escapes_before[:-1]
    for begin in range(0, len(data), _STEP):
        stop = min(begin + _STEP, len(data))
        own = data[begin:stop]
        marked = _ESCAPED[own]
        done = np.searchsorted(escapes, begin)
        inside = np.diff(np.clip(offsets, begin, stop))
        place = np.arange(begin, stop) + np.cumsum(marked) + done + np.repeat(shift, inside)
        out[place] = own
        out[place[marked] - 1] = _BACKSLASH
    return out, ends, list(zip(text_at.tolist(), tail_at.tolist()))


def _escaped_role(role: str | None) -> bytes:
    return b"".join(
        b"\\" + bytes([c]) if _ESCAPED[c] or c == _COLON else bytes([c])
        for c in (role or "").encode()
    )


class PieceReader:
    """Turns of a piece of chat text, found from its bytes alone."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        slash = raw == _BACKSLASH
        place = np.arange(len(raw))
        # Distance to the last byte before that is no backslash tells which one escapes.
        last_plain = np.maximum.accumulate(np.where(slash, -1, place))
        self.leads = slash & ((place - last_plain) % 2 == 1)
        escaped = np.zeros(len(raw), dtype=bool)
        escaped[1:] = self.leads[:-1]
        self.ends = np.flatnonzero((raw == _TURN_END) & ~escaped)
        self.colons = np.flatnonzero((raw == _COLON) & ~escaped)

    def plain(self, begin: int, end: int) -> bytes:
        return self.raw[begin:end][~self.leads[begin:end]].tobytes()

    def turns(self) -> Iterator[tuple[bytes, bytes]]:
        begin = 0
        for end in self.ends.tolist():
            colon = int(self.colons[np.searchsorted(self.colons, begin)])
            yield self.plain(begin + len(HEAD), colon), self.plain(colon + len(BETWEEN), end)
            begin = end + len(TAIL)


class Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: pa.Scalar, spans: list[dict]) -> None:
        buffer = piece.as_buffer()
        raw = np.frombuffer(buffer, dtype=np.uint8) if buffer and buffer.size else np.empty(0, np.uint8)
        reader = PieceReader(raw)
        for role, text in reader.turns():
            self.n_turns += 1
            self.turn_hash.update(role + b"\n" + text + b"\n")
        for span in spans:
            text = reader.plain(span["begin"], span["end"])
            self.loss_hash.update(text)
            self.loss_chars += len(text.decode())
        self.formatted_chars += int(np.count_nonzero((raw & 0xC0) != 0x80))

    def row(self) -> list:
        return [
            self.n_turns,
            self.turn_hash.hexdigest(),
            self.loss_chars,
            self.loss_hash.hexdigest(),
            self.formatted_chars,
        ]


def digests(pieces: DataFrame) -> DataFrame:
    """``conv_id`` and counts and hashes of each conversation, read back from ``formatted()``.

    A hash has to take a conversation in order. Conversations that lie within one task are
    done there; those at the two ends of a task and very large ones travel, as pieces, and each is
    hashed by one task, piece by piece.
    """
    inside = pieces.mapInArrow(_digested_inside, f"{_PIECES}, {_DIGESTS}")
    together = inside.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return together.mapInArrow(_digested_rest, f"conv_id bigint, {_DIGESTS}")


def _digested_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [
        ("conv_id", pa.int64()),
        ("part", pa.int32()),
        ("seq", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ]
    done_types = [(n, pa.string() if "sha" in n else pa.int64()) for n in _DIGEST_NAMES]

    def as_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        nothing = [pa.nulls(batch.num_rows, kind) for _, kind in done_types]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *nothing], [*batch.schema.names, *_DIGEST_NAMES]
        )

    def as_done(rows: list[list]) -> pa.RecordBatch:
        own = [pa.array([r[0] for r in rows], pa.int64())]
        own += [pa.nulls(len(rows), kind) for _, kind in types[1:]]
        own += [
            pa.array([r[k + 1] for r in rows], kind) for k, (_, kind) in enumerate(done_types)
        ]
        return pa.RecordBatch.from_arrays(own, [n for n, _ in [*types, *done_types]])

    # The first conversation and the last one may go on in another task, so they travel. Until the
    # open one ends, its pieces are held as they came; a digest cannot be undone. One that grows
    # beyond a bound travels as well.
    open_id: tuple | None = None
    travels, held, held_bytes = False, [], 0
    for batch in batches:
        rows = []
        ids = batch.column("conv_id").to_pylist()
        cuts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        sizes = pc.binary_length(batch.column("formatted")).to_numpy()
        for begin, end in zip(cuts, [*cuts[1:], len(ids)]):
            if (ids[begin],) != open_id:
                if held:
                    rows.append([*open_id, *_digest_of(held).row()])
                travels, held, held_bytes = open_id is None, [], 0
                open_id = (ids[begin],)
            run = batch.slice(begin, end - begin)
            if travels:
                yield as_pieces(run)
                continue
            held.append(run)
            held_bytes += int(sizes[begin:end].sum())
            if held_bytes > HELD_BYTES:
                yield from map(as_pieces, held)
                travels, held = True, []
        if rows:
            yield as_done(rows)
    yield from map(as_pieces, held)


def _digest_of(runs: list[pa.RecordBatch]) -> Digest:
    digest = Digest()
    for run in runs:
        for piece, spans in zip(run.column("formatted"), run.column("spans")):
            digest.add(piece, spans.as_py())
    return digest


def _digested_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *_DIGEST_NAMES]
    kinds = [pa.int64(), *(pa.string() if "sha" in n else pa.int64() for n in _DIGEST_NAMES)]

    def emitted(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names
        )

    open_id, digest, rows = None, None, []
    for batch in batches:
        done = batch.select(names).to_pylist()
        pieces, spans = batch.column("formatted"), batch.column("spans")
        for k, row in enumerate(done):
            if digest is not None and row["conv_id"] != open_id:
                rows.append([open_id, *digest.row()])
                digest = None
            if row["turns_sha256"] is not None:
                rows.append([row[n] for n in names])
                continue
            if digest is None:
                open_id, digest = row["conv_id"], Digest()
            digest.add(pieces[k], spans[k].as_py())
        if len(rows) >= 10_000:
            yield emitted(rows)
            rows = []
    if digest is not None:
        rows.append([open_id, *digest.row()])
    if rows:
        yield emitted(rows)
