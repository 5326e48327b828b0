"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries are scaled to integers, and the distinct vectors are the list that is fitted. With X for
that list, centred, Spark alternates the products p = Xy and Xᵀp; both are taken of a block of
rows at once, and only sums as long as one vector come back. The bidiagonal matrix they give has
the singular values of X, and its small decomposition yields the components and deviations.

Full reorthogonalisation on both sides needs no left vectors in store: each is u = Xz for a
short z, so its products with others follow from z and Xᵀp. All that the driver holds is
as wide as a vector and as long as the number of steps, which is at most that width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.llm.storage import stored

COMPONENTS = 16
SCALE = 64
# A residual below this share of the largest singular value is settled; rounding is of this size.
SETTLED = 1e-14
# What is below this share of the largest singular value counts as no variance at all.
NOTHING = 1e-11
BLOCK_BYTES = 4 << 20
_LONGEST = float(1 << 63)


@dataclass
class Whitening:
    """What was fitted: ``components`` are columns, ``sums`` and ``n`` are of the fit list."""

    width: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float


def fit(
    vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> Whitening:
    """The leading principal components of the distinct scaled vectors.

    An entry c counts as floor(scale * c). Rows without a vector, or with an entry that is null,
    infinite or no number, are left out, and so are vectors of another width than most distinct
    vectors have (of two equally frequent widths the larger counts) and empty ones. A direction
    without variance is no component, so there may be fewer than asked for, or none. Other
    columns are ignored. Raises OverflowError where a scaled entry does not fit 2**53.
    """
    scaled = vectors.select(F.col(column).alias("vector")).mapInArrow(
        _packer(scale), "width int, kind int, x binary"
    )
    blocks = stored(
        scaled.distinct().mapInArrow(_blocks, "width int, kind int, n long, data binary"),
        "whitening",
    )
    widths = blocks.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width"))
    most = widths.first()
    if most is None:
        return Whitening(0, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    width, n = most
    blocks = blocks.where(F.col("width") == width)
    sums = _summed(blocks, _sums(), width, "long")
    mean = sums / n

    def product(y: np.ndarray) -> tuple[np.ndarray, float]:
        out = _summed(blocks, _alternated(mean, y), width + 1)
        return out[:-1], float(out[-1])

    sizes, found = _leading(product, width, components)
    there = sizes > NOTHING * max(sizes.max(initial=0.0), 1e-300)
    variances, found = sizes[there] ** 2 / n, found[:, there]
    k = len(variances)
    spread = _summed(blocks, _moments(mean, found / np.sqrt(variances)), k * k + k + 1)
    about = spread[k * k : -1] / n
    covariance = spread[: k * k].reshape(k, k) / n - np.outer(about, about)
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return Whitening(width, n, sums, found, variances, float(spread[-1]) / n, error)


def whitened(
    vectors: DataFrame,
    model: Whitening,
    column: str = "embedding",
    carry: tuple[str, ...] = ("vec_id",),
    scale: int = SCALE,
) -> DataFrame:
    """A row per vector and component: the columns ``carry`` and ``component, n, deviation,
    whitened, explained, identity_error``.

    Rows that ``fit`` leaves out have no rows; repeated rows have theirs each. ``deviation`` is the
    sum of (n * x - S)² over the entries, exact; null where it does not fit a long.
    """
    schema = vectors.select(*carry).schema.simpleString()[7:-1].replace(":", " ")
    return vectors.select(*carry, F.col(column).alias("_vector")).mapInArrow(
        _whitener(model, carry, scale),
        schema + ", component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double",
    )


def _scaled(vectors: pa.Array, scale: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Width, places and scaled entries of the usable vectors, by width."""
    valid = ~np.asarray(vectors.is_null())
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries) | np.asarray(values.is_null()))])
    lengths = np.diff(offsets)
    valid &= (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    out = []
    for width in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == width))
        x = np.floor(scale * entries[offsets[rows][:, None] + np.arange(width)])
        if np.abs(x).max() > 1 << 53:
            raise OverflowError("a scaled entry does not fit 2**53")
        out.append((width, rows, x.astype(np.int64)))
    return out


def _packer(scale: int):
    """Each usable vector in the fewest bytes an entry that hold it, so equal ones look alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, _, x in _scaled(batch.column("vector"), scale):
                kinds = np.full(len(x), 8)
                for kind in (4, 2, 1):
                    limit = 1 << (8 * kind - 1)
                    kinds[(x.min(axis=1) >= -limit) & (x.max(axis=1) < limit)] = kind
                for kind in np.unique(kinds).tolist():
                    own = x[kinds == kind].astype(f"<i{kind}")
                    packed = pa.Array.from_buffers(
                        pa.binary(width * kind), len(own), [None, pa.py_buffer(own.tobytes())]
                    )
                    size = pa.array(np.full(len(own), width, np.int32))
                    kind_of = pa.array(np.full(len(own), kind, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [size, kind_of, packed.cast(pa.binary())], ["width", "kind", "x"]
                    )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width, kind = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
        for w, k in np.unique(np.stack([width, kind], axis=1), axis=0).tolist():
            rows = np.flatnonzero((width == w) & (kind == k))
            step = max(BLOCK_BYTES // (w * k), 1)
            for at in range(0, len(rows), step):
                own = batch.column("x").take(pa.array(rows[at : at + step])).to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "width": pa.array([w], pa.int32()),
                        "kind": pa.array([k], pa.int32()),
                        "n": [len(own)],
                        "data": pa.array([b"".join(own)], pa.binary()),
                    }
                )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, kind, data in zip(*(batch.column(c) for c in ("width", "kind", "data"))):
            raw = np.frombuffer(data.as_buffer(), dtype=f"<i{kind.as_py()}")
            yield raw.reshape(-1, width.as_py())


def _summed(blocks: DataFrame, partial, size: int, kind: str = "double") -> np.ndarray:
    """The arrays that ``partial`` makes of the matrices of a task, added up entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for matrix in _matrices(batches):
            own = partial(matrix)
            total = own if total is None else total + own
        if total is not None:
            place = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total)], ["place", "v"])

    rows = (
        blocks.select("width", "kind", "data")
        .mapInArrow(run, f"place int, v {kind}")
        .groupBy("place")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for place, value in rows:
        out[place] = value
    return out


def _sums():
    return lambda x: x.sum(axis=0, dtype=np.int64)


def _alternated(mean: np.ndarray, y: np.ndarray):
    """Xᵀ(Xy), and the squared length of Xy behind it."""

    def partial(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        p = centred @ y
        return np.append(centred.T @ p, p @ p)

    return partial


def _moments(mean: np.ndarray, axes: np.ndarray):
    """Sums of products and sums of the whitened rows, and of the squared centred entries."""

    def partial(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        w = centred @ axes
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [np.sum(centred**2)]])

    return partial


Product = Callable[[np.ndarray], tuple[np.ndarray, float]]


def _leading(product: Product, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of X, falling, and their right vectors as columns.

    A run that settles early sees one vector of each repeated singular value. Further runs, held
    orthogonal to what is found, look for others until the largest that is left is smaller.
    """
    sizes, found, whole = _bidiagonalised(product, width, wanted, np.zeros((width, 0)))
    while not whole and found.shape[1] < width:
        size, more, _ = _bidiagonalised(product, width, 1, found)
        if not len(size) or size[0] < sizes[:wanted].min():
            break
        order = np.argsort(-np.append(sizes, size), kind="stable")
        sizes = np.append(sizes, size)[order]
        found = np.hstack([found, more])[:, order]
    return sizes[:wanted], found[:, :wanted]


def _bidiagonalised(
    product: Product, width: int, wanted: int, locked: np.ndarray
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Singular values and right vectors of X within the complement of ``locked``, and whether
    that whole complement was gone through. Stops early once the ``wanted`` largest are settled."""
    random = np.random.default_rng(11)
    right = locked  # locked vectors, then v
    first = locked.shape[1]
    short, back = np.zeros((width, 0)), np.zeros((width, 0))  # z with u = Xz, and Xᵀu
    middle = np.zeros((width, width))  # u by v
    largest, beta, v = 0.0, 0.0, _orthogonal(random.standard_normal(width), right)
    while right.shape[1] < width:
        right = np.column_stack([right, v])
        step, n_left = right.shape[1] - first - 1, short.shape[1]
        y = v
        if beta:
            middle[n_left - 1, step] = beta
            y = v - beta * short[:, -1]
        across, square = product(y)
        drift = short.T @ across
        if drift @ drift > 1e-8 * square:  # what was taken off is felt: multiply anew
            y = y - short @ drift
            across, square = product(y)
            drift = short.T @ across
        y, across = y - short @ drift, across - back @ drift
        alpha = float(np.sqrt(max(square - drift @ drift, 0.0)))
        largest = max(largest, alpha)
        rest = np.zeros(width)
        if alpha > NOTHING * largest:
            middle[n_left, step] = alpha
            short = np.column_stack([short, y / alpha])
            back = np.column_stack([back, across / alpha])
            rest = back[:, -1] - alpha * v
            for _ in range(2):
                rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta <= NOTHING * largest:  # an invariant space: go on from another direction
            beta, v = 0.0, _orthogonal(random.standard_normal(width), right)
            continue
        v = rest / beta
        if step + 1 >= wanted and (step + 1) % 4 == 0:
            left, sizes, _ = np.linalg.svd(middle[: short.shape[1], : step + 1])
            if (beta * np.abs(left[-1, :wanted]) <= SETTLED * sizes[0]).all():
                break
    steps = right.shape[1] - first
    _, sizes, across = np.linalg.svd(middle[:steps, :steps])
    own = right[:, first:] @ across[:wanted].T
    return sizes[:wanted], own, right.shape[1] == width


def _orthogonal(v: np.ndarray, others: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - others @ (others.T @ v)
        norm = np.linalg.norm(v)
        v = v / norm if norm > 0 else v
    return v


def _whitener(model: Whitening, carry: tuple[str, ...], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        axes = model.components / np.sqrt(model.variances)
        mean = model.sums / max(model.n, 1)
        explained = model.variances / model.total_variance if k else np.zeros(0)
        names = [*carry, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for width, rows, x in _scaled(batch.column("_vector"), scale):
                if width != model.width or not k:
                    continue
                apart = model.n * x - model.sums
                # Products wrap modulo 2**64, so a sum that fits is right whatever came before.
                deviation = (apart * apart).sum(axis=1)
                fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 0.999 * _LONGEST
                own = pa.array(np.repeat(rows, k))
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).take(own) for name in carry),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, dtype=np.int64)),
                        pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                        pa.array(((x - mean) @ axes).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names,
                )

    return run
