"""Near-duplicate documents: MinHash with tensored tables, confirmed on full shingle sets.

Two collections of ``half_tables`` half keys are made from minhashes. A table's key joins one
half key of each collection, so ``half_tables`` squared tables cost only twice ``half_tables``
half keys: the minhash work is about a square root of the usual. Two documents meet in a table
only if they share a half key of both collections; half keys that no other document has are
therefore dropped before any key is formed, which leaves most documents without keys.

Candidates are confirmed without listing the pairs of a table entry:

1. Equal shingle sets are one class, which its smallest doc_id stands for.
2. Each class is compared with the smallest member of every entry it is in. Entries whose
   members are then in one component need nothing more.
3. The members of all other entries are dealt into blocks of a bounded number of shingles. Two
   blocks that meet in an entry are compared as a whole, inside one task, and only links between
   components are returned. Nothing is capped, and a large entry is spread over many tasks.

With 10 half keys of 2 minhashes a pair at similarity 0.75 meets with a probability of 0.9995,
at 0.8 of 0.9999.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.llm import words
from skyvane.llm.storage import components, stored

HALF_TABLES = 10
HALF_ROWS = 2
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
# Shingles of the documents that are compared in one task, and in one matrix product.
BLOCK_SHINGLES = 1 << 20
TILE_SHINGLES = 1 << 15


def near_duplicates(
    documents: DataFrame,
    half_tables: int = HALF_TABLES,
    half_rows: int = HALF_ROWS,
    percent: int = SIMILARITY_PERCENT,
    shingle_words: int = SHINGLE_WORDS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``documents(doc_id, text)``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than
    ``shingle_words`` words is one shingle; without words or text it has none and is linked
    with nothing. ``component_id`` is the smallest doc_id reached over links with at least
    ``percent`` hundredths of the union shared. Equal rows get equal results; rows that share
    a doc_id with different texts are one node of the graph; a row without doc_id is linked
    with nothing, has a null component and is kept. Other columns are ignored.
    """
    narrow = documents.select("doc_id", "text")
    sketches = stored(
        narrow.mapInArrow(
            _sketcher(half_tables, half_rows, shingle_words),
            "doc_id long, n_shingles long, print1 long, print2 long, halves array<long>",
        ),
        "sketches",
    )
    same_set = ["print1", "print2"]
    # Written, so that the joins with it have shuffles of their own, which Spark can split.
    nodes = stored(
        sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*same_set)
        .agg(F.min("doc_id").alias("node")),
        "nodes",
    )
    entries = stored(_entries(sketches, nodes), "entries")
    sets = stored(_sets(narrow, entries, shingle_words), "sets")

    stars = entries.where("node != center").select("center", "node").distinct()
    near = stored(_confirmed(stars, sets, percent), "links")
    first = stored(components(near.select(F.col("center").alias("u"), F.col("node").alias("v"))), "components")
    cross = _links_between_components(entries, first, sets, percent, block_shingles)
    second = components(stored(cross, "links")).select(
        F.col("node").alias("component"), F.col("component").alias("final")
    )
    found = (
        first.join(second, "component", "full")
        .select(
            F.coalesce("node", "component").alias("node"),
            F.coalesce("final", "component").alias("component"),
        )
    )
    placed = sketches.join(nodes, same_set, "left").join(found, "node", "left")
    own = F.col("n_shingles") > 0
    component = F.when(own & F.col("doc_id").isNotNull(), F.coalesce("component", "node")).otherwise(
        F.col("doc_id")
    )
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _sketcher(half_tables: int, half_rows: int, shingle_words: int):
    n_hashes = 2 * half_tables * half_rows
    seeded = np.random.Generator(np.random.PCG64(7))
    turned = seeded.integers(1, 1 << 63, n_hashes, dtype=np.uint64)
    factor = seeded.integers(1, 1 << 63, n_hashes, dtype=np.uint64) | np.uint64(1)

    def sketch_block(sets: list[np.ndarray]) -> np.ndarray:
        """Half keys of each non-empty set; the lowest bit tells the collection."""
        joined = np.concatenate(sets)
        begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
        halves = np.zeros((len(sets), 2 * half_tables), dtype=np.uint64)
        for place in range(n_hashes):
            least = np.minimum.reduceat((joined ^ turned[place]) * factor[place], begins)
            half = place // half_rows
            halves[:, half] = words.mixed(halves[:, half] + least + np.uint64(half + 1))
        side = np.arange(2 * half_tables, dtype=np.uint64) & np.uint64(1)
        return (halves & ~np.uint64(1)) | side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                sets = words.shingles(block, shingle_words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                prints = np.zeros((len(sets), 2), dtype=np.int64)
                for row, found in enumerate(sets):
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    prints[row] = np.frombuffer(digest, dtype=np.int64)
                full = [s for s in sets if len(s)]
                halves = sketch_block(full) if full else np.empty((0, 2 * half_tables))
                ends = np.cumsum(np.where(n > 0, 2 * half_tables, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n_texts),
                        pa.array(n),
                        pa.array(prints[:, 0]),
                        pa.array(prints[:, 1]),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                            pa.array(halves.astype(np.uint64).view(np.int64).ravel()),
                        ),
                    ],
                    ["doc_id", "n_shingles", "print1", "print2", "halves"],
                )

    return run


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows ``(node, key)`` whose key another node has too, with the smallest such node."""
    ends = rows.groupBy(key).agg(F.min("node").alias("center"), F.max("node").alias("_last"))
    return rows.join(ends.where("center != _last").drop("_last"), key)


def _entries(sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node, center`` for every entry of a table that holds two classes or more."""
    reps = sketches.join(nodes, ["print1", "print2"]).where("doc_id = node")
    halves = reps.select("node", F.explode("halves").alias("half"))
    of_node = (
        _shared(halves, "half")
        .groupBy("node")
        .agg(F.collect_set("half").alias("halves"))
    )

    def side(bit: int) -> Column:
        return F.filter("halves", lambda half: half.bitwiseAND(F.lit(1)) == bit)

    keys = of_node.select("node", side(0).alias("left"), F.explode(side(1)).alias("right")).select(
        "node", "right", F.explode("left").alias("left")
    )
    return _shared(keys.select("node", F.xxhash64("left", "right").alias("key")), "key")


def _sets(documents: DataFrame, entries: DataFrame, shingle_words: int) -> DataFrame:
    """``node, size, shingles`` of the classes in ``entries``; equal rows are read once."""
    wanted = entries.select(F.col("node").alias("doc_id")).distinct()
    texts = (
        documents.join(wanted, "doc_id", "left_semi")
        .withColumn("content", F.xxhash64("text"))
        .dropDuplicates(["doc_id", "content"])
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                sets = words.shingles(block, shingle_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.row, block.n_texts),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "size", "shingles"],
                )

    return texts.mapInArrow(run, "node long, size long, shingles binary").where("size > 0")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("center"), F.col("shingles").alias("one"))
    two = sets.select("node", F.col("shingles").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("one"), batch.column("two")):
                x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["center", "node"]).filter(pa.array(linked, pa.bool_()))

    return (
        pairs.join(one, "center")
        .join(two, "node")
        .select("center", "node", "one", "two")
        .mapInArrow(run, "center long, node long")
    )


def _links_between_components(
    entries: DataFrame, first: DataFrame, sets: DataFrame, percent: int, block_shingles: int
) -> DataFrame:
    """``u, v``: components that a link joins, found in entries with more than one component."""
    members = entries.join(first, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    ends = members.groupBy("key").agg(
        F.min("component").alias("label"), F.max("component").alias("_last")
    )
    open_entries = stored(
        members.join(ends.where("label != _last").drop("_last"), "key"), "open"
    )
    # Documents that meet often share the smallest component they meet, and so mostly a block.
    labels = open_entries.groupBy("node", "component").agg(F.min("label").alias("label"))
    sized = labels.join(sets.groupBy("node").agg(F.max("size").alias("size")), "node")
    parts = sized.groupBy("label").agg(
        F.ceil(F.sum("size") / F.lit(block_shingles)).alias("parts")
    )
    blocks = stored(
        sized.join(parts, "label").select(
            "node",
            "component",
            F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts")).alias("block"),
        ),
        "blocks",
    )
    at = open_entries.select("key", "node").join(blocks, "node").select("key", "block").distinct()
    meeting = (
        at.join(at.select("key", F.col("block").alias("other")), "key")
        .where("block <= other")
        .select("block", "other")
        .distinct()
    )
    meeting = stored(meeting, "meeting")
    sides = meeting.select("block", "other", F.col("block").alias("at")).unionByName(
        meeting.where("block != other").select("block", "other", F.col("other").alias("at"))
    )
    content = blocks.withColumnRenamed("block", "at").join(sets, "node")
    gathered = sides.join(content, "at").select(
        "block", "other", "at", "node", "component", "shingles"
    )

    def compare(group: pa.Table) -> pa.Table:
        return _compared(group, percent)

    return gathered.groupBy("block", "other").applyInArrow(compare, "u long, v long")


def _compared(group: pa.Table, percent: int) -> pa.Table:
    """Links between components of two blocks, or inside one, by products of 0/1 matrices."""
    block, other = group.column("block")[0].as_py(), group.column("other")[0].as_py()
    at = group.column("at").to_numpy()
    component = group.column("component").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in group.column("shingles")]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.lexsort((sizes, component))
    sides = []
    for which in (block, other):
        rows = order[at[order] == which]
        piece = (np.cumsum(sizes[rows]) - sizes[rows]) // TILE_SHINGLES
        cuts = np.flatnonzero(np.diff(piece)) + 1
        sides.append([t for t in np.split(rows, cuts) if len(t)])
    tiles = {}

    def tile(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if rows[0] not in tiles:
            joined = np.concatenate([sets[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            tiles[rows[0]] = joined, owner, np.unique(joined)
        return tiles[rows[0]]

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, mine in enumerate(sides[0]):
        for theirs in sides[1][i:] if block == other else sides[1]:
            if len({find(c) for c in (*component[mine].tolist(), *component[theirs].tolist())}) < 2:
                continue
            n, m = sizes[mine], sizes[theirs]
            if 100 * n.max() < percent * m.min() or 100 * m.max() < percent * n.min():
                continue
            a, a_owner, a_set = tile(mine)
            b, b_owner, b_set = tile(theirs)
            common = np.intersect1d(a_set, b_set, assume_unique=True)
            if not len(common):
                continue
            x = _incidence(a, a_owner, len(mine), common)
            y = _incidence(b, b_owner, len(theirs), common)
            both = np.rint(x @ y.T).astype(np.int64)
            for p, q in zip(*np.nonzero(100 * both >= percent * (n[:, None] + m[None, :] - both))):
                u, v = find(int(component[mine[p]])), find(int(component[theirs[q]]))
                if u != v:
                    root[max(u, v)] = min(u, v)
    return pa.table(
        {"u": pa.array(list(root), pa.int64()), "v": pa.array([find(u) for u in root], pa.int64())}
    )


def _incidence(joined: np.ndarray, owner: np.ndarray, n: int, common: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(common, joined), len(common) - 1)
    inside = common[at] == joined
    out = np.zeros((n, len(common)), dtype=np.float32)
    out[owner[inside], at[inside]] = 1
    return out
