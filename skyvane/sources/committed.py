"""Tables of files with a list of commits that readers follow.

A write first lays its files beside those of others, each row marked with the write. Nothing of
it is seen until one small file, created under the next free number, names the write; then all
of it is. So readers never see half a batch, a batch that runs again under its key changes
nothing, batch jobs and streams can share a table, and no write needs a folder that stays.

Compaction rewrites closed days into few files. Its commit names the days and the last commit it
has seen: rows of those days from commits up to that one are hidden, rows that came meanwhile
are not. ``vacuum`` deletes what is hidden.

The file system has to create a file exclusively, as HDFS and local ones do; elsewhere let one
job at a time commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F

from skyvane import schemas
from skyvane.operators.windows import TIME_ORDER, latest_per_location

COMMIT = (
    "number BIGINT, key STRING, write STRING, days ARRAY<DATE>, upto BIGINT, note STRING"
)


class Conflict(RuntimeError):
    """Another writer's commit came in between."""


class _Files:
    """The few calls on the file system that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def make_folder(self, folder: str) -> None:
        self._system.mkdirs(self._path(folder))

    def names(self, folder: str) -> list[str]:
        return [status.getPath().getName() for status in self._system.listStatus(self._path(folder))]

    def created(self, file: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        try:
            out = self._system.create(self._path(file), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def move(self, file: str, folder: str) -> None:
        self.make_folder(folder)
        name = file.rsplit("/", 1)[1]
        if not self._system.rename(self._path(file), self._path(f"{folder}/{name}")):
            raise OSError(f"could not move {file} to {folder}")

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)


def listed_upto(spark: SparkSession, number: int) -> DataFrameReader:
    """A reader whose scans equal no scan of the same folder at another time. Spark compares
    scans by folder and options, not by the files they list, and may reuse one for the other."""
    return spark.read.option("listedUpto", str(number))


class CommitList:
    """Numbered commits, one small file each; a file that is cut short counts as none."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._files = _Files(spark, folder)
        self._files.make_folder(folder)

    def entries(self) -> DataFrame:
        """The commits that there are now."""
        listed = listed_upto(self._spark, self.newest_number())
        return listed.schema(COMMIT).json(self._folder).where("write IS NOT NULL")

    def has(self, key: str) -> bool:
        return not self.entries().where(F.col("key") == key).isEmpty()

    def newest_number(self) -> int:
        return max(self._numbers(), default=0)

    def newest(self) -> Row | None:
        return self.entries().orderBy(F.desc("number")).first()

    def add(
        self,
        key: str,
        write: str,
        days: list | None = None,
        upto: int | None = None,
        note: str | None = None,
        refuse: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int:
        """Commit ``write`` under the next free number and return it. Raises Conflict if
        ``refuse`` keeps any of the commits that are there by then."""
        while True:
            number = self.newest_number() + 1
            if refuse is not None and not refuse(self.entries()).isEmpty():
                raise Conflict(key)
            days_text = [str(day) for day in days or []]
            entry = dict(
                number=number, key=key, write=write, days=days_text, upto=upto, note=note
            )
            if self._files.created(f"{self._folder}/{number:020d}.json", json.dumps(entry)):
                return number

    def drop(self, numbers: list[int]) -> None:
        for number in numbers:
            self._files.delete(f"{self._folder}/{number:020d}.json")

    def _numbers(self) -> list[int]:
        names = self._files.names(self._folder)
        return [int(name[:-5]) for name in names if name.endswith(".json") and name[0] != "."]


class CommittedTable:
    """Rows of ``columns``, in folders by ``day`` where it is given, ordered by ``order`` within
    a file."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        columns: str,
        day: str | None = None,
        order: tuple[str, ...] = (),
    ):
        self._spark, self._day, self._order = spark, day, order
        self._data, self._staging = f"{folder}/data", f"{folder}/staging"
        self._schema = f"{columns}, {day} DATE" if day else columns
        self._files = _Files(spark, folder)
        self._files.make_folder(self._data)
        self.commits = CommitList(spark, f"{folder}/commits")

    def append(self, rows: DataFrame, key: str) -> bool:
        """Add ``rows`` as the batch ``key``; False, and nothing written, if it is there."""
        if self.commits.has(key):
            return False
        write = self._written(rows.sortWithinPartitions(*self._sorted()) if self._order else rows)
        self.commits.add(key, write, refuse=lambda entries: entries.where(F.col("key") == key))
        return True

    def rows(self, numbered: str | None = None) -> DataFrame:
        """What is committed now; with the number of the commit as column ``numbered``."""
        seen = self._visible().drop("_write", "_file")
        return seen.withColumnRenamed("_number", numbered) if numbered else seen.drop("_number")

    def compact(self, before, most_files: int = 4, rows_per_file: int = 4_000_000) -> list:
        """Rewrite the days before the date ``before`` that lie in more than ``most_files`` files,
        and return them. Rows are cut by range, so short days share a task and neither a long
        day nor a single instant has to fit one. Raises Conflict if another compaction came in
        between; its rows stay and those of this one are never seen."""
        seen = self.commits.newest_number()
        visible = self._visible().where(F.col("_number") <= seen)
        scattered = (
            visible.where(F.col(self._day) < F.lit(before).cast("date"))
            .select(self._day, "_file")
            .distinct()
            .groupBy(self._day)
            .count()
            .where(F.col("count") > most_files)
        )
        days = sorted(row[0] for row in scattered.collect())
        if not days:
            return []
        own = visible.where(F.col(self._day).isin(days)).drop("_write", "_number", "_file")
        cut = own.repartitionByRange(*self._sorted()).sortWithinPartitions(*self._sorted())
        write = self._written(cut, rows_per_file)
        self.commits.add(
            f"compaction-{write}",
            write,
            days,
            seen,
            refuse=lambda entries: entries.where((F.col("number") > seen) & F.col("upto").isNotNull()),
        )
        return days

    def vacuum(self, older_than_hours: float = 24, keep: int = 1000) -> int:
        """Delete the files without a visible row, and return how many. Those of writes that are
        not committed may be of a write that still runs; they have to be older than the given
        hours. Of commits that no file refers to any more the newest ``keep`` stay."""
        newest = self.commits.newest_number()
        commits = self.commits.entries()
        used = self._visible(commits).select("_file").distinct()
        files = self._scanned(modified=True).select("_file", "_write", "_modified").distinct()
        known = commits.select(F.col("write").alias("_write"), F.lit(True).alias("_known"))
        deadline = F.lit(time.time() - 3600 * older_than_hours).cast("timestamp")
        hidden = files.join(used, "_file", "left_anti").join(known, "_write", "left")
        garbage = hidden.where(F.col("_known") | (F.col("_modified") < deadline)).select("_file")
        n = 0
        for row in garbage.toLocalIterator():
            self._files.delete(row[0])
            n += 1
        unused = commits.where(F.col("number") <= newest - keep).join(
            self._scanned().select(F.col("_write").alias("write")).distinct(), "write", "left_anti"
        )
        self.commits.drop([row.number for row in unused.select("number").collect()])
        return n

    def _sorted(self) -> list[str]:
        return [*([self._day] if self._day else []), *self._order]

    def _scanned(self, modified: bool = False) -> DataFrame:
        listed = listed_upto(self._spark, self.commits.newest_number())
        seen = listed.schema(f"{self._schema}, _write STRING").parquet(self._data)
        extra = [F.col("_metadata.file_path").alias("_file")]
        if modified:
            extra.append(F.col("_metadata.file_modification_time").alias("_modified"))
        return seen.select("*", *extra)

    def _visible(self, commits: DataFrame | None = None) -> DataFrame:
        """Commits are listed before files, so that all files of a listed commit are found."""
        commits = self.commits.entries() if commits is None else commits
        writes = commits.select(F.col("write").alias("_write"), F.col("number").alias("_number"))
        rows = self._scanned().join(writes, "_write")
        if self._day is None:
            return rows
        floors = (
            commits.where("upto IS NOT NULL")
            .select(F.explode("days").alias("_floor_day"), "upto")
            .groupBy("_floor_day")
            .agg(F.max("upto").alias("_floor"))
        )
        same = F.col(self._day) == F.col("_floor_day")
        return (
            rows.join(floors, same, "left")
            .where(F.col("_number") > F.coalesce("_floor", F.lit(0)))
            .drop("_floor_day", "_floor")
        )

    def _written(self, rows: DataFrame, rows_per_file: int = 0) -> str:
        """Lay the files of a write beside the others. They are written elsewhere and moved, as
        two jobs that write to one folder would clear each other's unfinished files."""
        write = uuid.uuid4().hex
        staging = f"{self._staging}/{write}"
        writer = rows.withColumn("_write", F.lit(write)).write
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        (writer.partitionBy(self._day) if self._day else writer).parquet(staging)
        folders = [name for name in self._files.names(staging) if "=" in name] or [""]
        for folder in folders:
            here = f"{staging}/{folder}".rstrip("/")
            for name in self._files.names(here):
                if name.endswith(".parquet"):
                    self._files.move(f"{here}/{name}", f"{self._data}/{folder}".rstrip("/"))
        self._files.delete(staging)
        return write


class Versions:
    """A table that is replaced whole; readers follow the newest commit. A commit may carry a
    short ``note``."""

    def __init__(self, spark: SparkSession, folder: str, columns: str):
        self._spark, self._columns, self._versions = spark, columns, f"{folder}/versions"
        self._files = _Files(spark, folder)
        self._files.make_folder(self._versions)
        self.commits = CommitList(spark, f"{folder}/commits")

    def rows(self) -> DataFrame:
        return self._version(self.commits.newest())

    def replace(
        self, made: Callable[[DataFrame, str | None], tuple[DataFrame, str | None]], key: str
    ) -> bool:
        """Put what ``made`` makes of the current rows and note in their place, as the change
        ``key``; False, and no change, if it is in already. A change that another one overtakes
        starts again from the other one's version."""
        while not self.commits.has(key):
            before = self.commits.newest()
            rows, note = made(self._version(before), before.note if before else None)
            write = uuid.uuid4().hex
            rows.write.parquet(f"{self._versions}/{write}")
            base = before.number if before else 0
            try:
                self.commits.add(
                    key,
                    write,
                    note=note,
                    refuse=lambda entries: entries.where(F.col("number") > base),
                )
                return True
            except Conflict:
                self._files.delete(f"{self._versions}/{write}")
        return False

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the ``keep`` newest, and their commits but for a thousand."""
        entries = self.commits.entries().orderBy(F.desc("number")).collect()
        there = set(self._files.names(self._versions))
        for entry in entries[keep:]:
            if entry.write in there:
                self._files.delete(f"{self._versions}/{entry.write}")
        self.commits.drop([entry.number for entry in entries[max(keep, 1000) :]])

    def _version(self, entry: Row | None) -> DataFrame:
        if entry is None:
            return self._spark.createDataFrame([], self._columns)
        return self._spark.read.schema(self._columns).parquet(f"{self._versions}/{entry.write}")


class LatestReadings(Versions):
    """The newest reading of each location, kept up to date batch by batch.

    Each merge writes a version of one row per location, from the version before it and the
    newest readings of the batch alone; the history is not read. Late readings do not replace
    newer ones.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: str = schemas.WEATHER_DATA):
        super().__init__(spark, folder, columns)

    def merge(self, batch: DataFrame, key: str) -> bool:
        """Take in the readings of the batch ``key``; False, and no change, if it is in already."""

        def merged(current: DataFrame, _) -> tuple[DataFrame, None]:
            own = latest_per_location(batch.select(*current.columns))
            return latest_per_location(current.unionByName(own)), None

        return self.replace(merged, key)


# What orders stored readings within a day.
READING_ORDER = ("location", *TIME_ORDER)


def readings_table(spark: SparkSession, folder: str) -> CommittedTable:
    """Stored readings by day; rows to append come from ``sinks.storable``."""
    return CommittedTable(spark, folder, schemas.WEATHER_DATA, "recorded_date", READING_ORDER)


def feed_table(spark: SparkSession, folder: str) -> CommittedTable:
    return CommittedTable(spark, folder, "event STRING, payload STRING")
