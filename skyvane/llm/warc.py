"""WARC archives with an index that is written first and read from.

Writing puts each record, compressed on its own, into files of the shared folder and returns
one index row per record: file, offset, length, url and digest. Reading sorts the index rows
that are wanted by file and offset, joins neighbouring byte ranges into one read, and takes the
records out of it.

A task writes files with names of its own, and only the index rows of the attempt that Spark
accepts name them, so a task that runs again leaves no wrong record behind. Files are opened
with pyarrow, which reads and writes local paths, HDFS and object stores by their URI.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyvane.llm.storage import stored
from skyvane.session import shared_folder

LEAST_REVISIT_BYTES = 0
FILE_BYTES = 256 << 20
LEVEL = 5
# Unwanted bytes that a read takes along rather than starting another one, and its size.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
# Record bytes that a task reads, about.
TASK_BYTES = 16 << 20
# Fixed value: what the format calls a record whose payload is that of another one.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-31T00:00:00Z"

_INDEX = [
    ("file", pa.string()),
    ("offset", pa.int64()),
    ("length", pa.int64()),
    ("url", pa.string()),
    ("digest", pa.string()),
    ("page_id", pa.int64()),
    ("record_type", pa.string()),
]
_READ = [
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
    ("payload", pa.binary()),
]
_NAMES = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}


def written(
    pages: DataFrame,
    least_revisit_bytes: int = LEAST_REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` and return the index, itself a written table.

    Of pages with equal payloads of at least ``least_revisit_bytes`` bytes that with the
    largest page_id is a response, all others revisit it; pages with less are responses. A null
    payload is empty, a null url is left out, and a null page_id is below all others. Rows that
    repeat a page_id and payload get the same type each. Other columns are ignored.
    """
    own = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.sha1(F.coalesce("html", F.lit(""))).alias("sha"),
    )
    # Payloads that are there more than once; written, so that a very frequent one can be split.
    newest = stored(
        own.groupBy("sha")
        .agg(F.count("*").alias("n_rows"), F.max("page_id").alias("newest"))
        .where("n_rows > 1 AND newest IS NOT NULL")
        .select("sha", "newest"),
        "repeated-payloads",
    )
    repeats = (F.octet_length("html") >= least_revisit_bytes) & ~F.col("page_id").eqNullSafe(
        F.col("newest")
    )
    folder = shared_folder(pages.sparkSession, "warc")
    records = own.join(newest, "sha", "left").select(
        "page_id", "url", "html", F.when(repeats, F.col("newest")).alias("refers_to")
    )
    index = records.mapInArrow(_writer(folder, file_bytes), _schema(_INDEX))
    return stored(index, "warc-index")


def _schema(columns: list[tuple]) -> str:
    return ", ".join(f"{name} {_NAMES[kind]}" for name, kind in columns)


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[k] for row in rows], kind) for k, (_, kind) in enumerate(columns)],
        [name for name, _ in columns],
    )


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple:
    """A compressed record, and its digest and type."""
    digest = base64.b32encode(sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{digest}"]
    head.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = packer.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n")
    return raw + packer.flush(), digest, kind


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parsed(member: bytes) -> tuple:
    """``_READ`` of one compressed record. A response's digest and length are those of the
    payload that was read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]

    def page(name: str) -> int | None:
        value = fields[name][len("<urn:page:") : -1] if name in fields else ""
        return int(value) if value else None

    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        n, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:]
    else:
        n, digest = len(payload), base64.b32encode(sha1(payload).digest()).decode()
    return (
        page("WARC-Record-ID"),
        fields.get("WARC-Target-URI"),
        n,
        digest,
        fields["WARC-Type"],
        page("WARC-Refers-To"),
        None if revisit else payload,
    )


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(k) for k in ("page_id", "url", "html", "refers_to")]
                for page_id, url, html, refers_to in zip(*columns):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, path, offset = files.open_output_stream(f"{top}/{name}", compression=None), name, 0
                    payload = html.as_buffer()
                    raw, digest, kind = record(
                        page_id.as_py(),
                        url.as_py(),
                        payload.to_pybytes() if payload is not None else b"",
                        refers_to.as_py(),
                    )
                    out.write(raw)
                    rows.append(
                        (f"{folder}/{path}", offset, len(raw), url.as_py(), digest, page_id.as_py(), kind)
                    )
                    offset += len(raw)
                yield _batch(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the ``index`` rows: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and ``payload`` (null for a revisit) unless ``payloads`` is false."""
    wanted = index.select("file", "offset", "length")
    # An index row is small but stands for a record, so the tasks are counted by record bytes.
    total = wanted.agg(F.sum("length")).first()[0] or 0
    n_tasks = 1 + total // TASK_BYTES
    ordered = wanted.repartitionByRange(n_tasks, "file", "offset").sortWithinPartitions(
        "file", "offset"
    )
    columns = _READ if payloads else _READ[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            own = batch.to_pylist()
            begin = 0
            while begin < len(own):
                first = own[begin]
                stop, end = begin + 1, first["offset"] + first["length"]
                while stop < len(own):
                    item = own[stop]
                    upto = max(end, item["offset"] + item["length"])
                    if (
                        item["file"] != first["file"]
                        or item["offset"] - end > GAP_BYTES
                        or upto - first["offset"] > READ_BYTES
                    ):
                        break
                    stop, end = stop + 1, upto
                if opened != first["file"]:
                    if source is not None:
                        source.close()
                    files, path = FileSystem.from_uri(first["file"])
                    source, opened = files.open_input_file(path), first["file"]
                raw = source.read_at(end - first["offset"], first["offset"])
                rows = []
                for item in own[begin:stop]:
                    at = item["offset"] - first["offset"]
                    rows.append(parsed(raw[at : at + item["length"]]))
                yield _batch(rows, columns)
                begin = stop
        if source is not None:
            source.close()

    return ordered.mapInArrow(run, _schema(columns))
