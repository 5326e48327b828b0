"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes and shingles.

Texts come as Arrow string arrays. They are handled in blocks of a few megabytes, so memory
follows the block and the longest single text, not the batch. A hash is the same in every
process and at every place: it depends on the bytes of the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_HASH_BYTES = 1 << 15

_seeded = np.random.Generator(np.random.PCG64(20240131))
_BYTE_CODE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _seeded.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
# A multiplier that is 5 modulo 8 has few common factors of two in the differences of its powers.
_STEP = np.uint64((int(_seeded.integers(1, 1 << 60)) << 3) + 5)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# What stands between words: ASCII white space; or all of ASCII but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SIGNS = np.zeros(256, dtype=bool)
SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_AHEAD = _powers(_STEP, _HASH_BYTES)
_BACK = _powers(_STEP_BACK, _HASH_BYTES)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes evenly (the finaliser of a public multiplicative hash)."""
    out = codes ^ (codes >> np.uint64(33))
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


class Block:
    """Words of some consecutive texts; ``first`` has the first word of each text and the end."""

    def __init__(self, texts: pa.Array, row: int, separators: np.ndarray = SPACES):
        self.row = row
        self.n_texts = len(texts)
        offsets, self.data = text_bytes(texts)
        space = separators[self.data]
        # A text ends its last word even where the next text begins without a space.
        is_word = ~space
        starts = is_word.copy()
        starts[1:] &= space[:-1]
        ends = is_word.copy()
        ends[:-1] &= space[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[begins] = is_word[begins]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = is_word[last]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist())]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of the texts with A-Z lower-cased; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, bounds, content = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], _LOWER[data]


def slices(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``block_bytes``; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for row, n in enumerate(lengths.tolist()):
        if row > begin and total + n > block_bytes:
            yield begin, texts.slice(begin, row - begin)
            begin, total = row, 0
        total += n
    if len(texts) > begin:
        yield begin, texts.slice(begin)


def blocks(
    texts: pa.Array, block_bytes: int = BLOCK_BYTES, separators: np.ndarray = SPACES
) -> Iterator[Block]:
    for row, run in slices(texts, block_bytes):
        yield Block(run, row, separators)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, found from running sums."""
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = (ends - starts).astype(np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(int(np.searchsorted(ends, base + _HASH_BYTES - 1, side="right")), done + 1)
        out[done:upto] = _hash_run(data, starts[done:upto], ends[done:upto])
        done = upto
    return mixed(out + lengths * _PLACE[15])


def _hash_run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base, stop = starts[0], ends[-1]
    if stop - base >= _HASH_BYTES:  # a single word of this length
        total = np.uint64(0)
        scale = np.uint64(1)
        with np.errstate(over="ignore"):
            for at in range(base, stop, _HASH_BYTES):
                part = _BYTE_CODE[data[at : min(at + _HASH_BYTES, stop)]]
                total += scale * (part * _AHEAD[: len(part)]).sum(dtype=np.uint64)
                scale *= _AHEAD[-1] * _STEP
        return np.array([total], dtype=np.uint64)
    sums = np.zeros(stop - base + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data[base:stop]] * _AHEAD[: stop - base], out=sums[1:])
    return (sums[ends - base] - sums[starts - base]) * _BACK[starts - base]


def shingles(block: Block, size: int = 5) -> list[np.ndarray]:
    """For each text of the block the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    words = block.hashes()
    joined = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for place in range(size):
        joined += words[place : place + len(joined)] * _PLACE[place]
    joined = mixed(joined)
    out = []
    for begin, end in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
        n = end - begin
        if n >= size:
            out.append(np.unique(joined[begin : end - size + 1]))
        elif n:
            short = (words[begin:end] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
