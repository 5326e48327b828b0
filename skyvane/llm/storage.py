"""Written tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.session import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    What follows reads the files, so a lost executor costs the running stage alone and no row
    is computed twice. The folder is left for the owner of ``spark.checkpoint.dir`` to clear.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """Write ``df`` like ``stored``, dealt into as many buckets by ``key`` as a shuffle has
    partitions, so that what is grouped by that key later need not be shuffled again. The name
    under which the session knows the table is left as the files are."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, key).option("path", folder)
    writer.saveAsTable(name)
    return spark.table(name)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``component``: the smallest node that each node of ``edges(u, v)`` reaches.

    Alternates large and small stars: every node hands its larger, then its smaller neighbours
    to the smallest one. Only minima per node are grouped, never lists of neighbours, and the
    number of rounds grows with the logarithm of the longest path. Raises if ``rounds`` do not
    suffice.
    """
    current = stored(_downward(edges), "edges")
    state = _state(current)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _downward(both.join(least, "u").where("v > u").select("v", F.col("m").alias("u")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select("u", F.col("m").alias("v"))
        current = stored(_downward(handed.unionByName(kept)), "edges")
        before, state = state, _state(current)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots
    )


def _downward(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    half = F.shiftright(F.xxhash64("u", "v"), 20)
    return tuple(edges.agg(F.count("*"), F.sum(half)).first())
