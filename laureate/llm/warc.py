"""WARC archives: a writer and a splittable reader.

Each record is a gzip member of its own, so an archive can be read from any
member on. The reader's tasks take byte ranges: a task looks for the gzip magic
number in its range, accepts a candidate whose first bytes decode to a WARC
header, and owns the records that begin inside its range, also where they end
beyond it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import column, heavy_split, new_folder, table, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this size are always written whole.
LEAST_REVISIT = 1000
ARCHIVE_BYTES, SPLIT_BYTES, CHUNK = 256 << 20, 8 << 20, 256 << 10
#: The records carry no time of their own.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _file_system(path: str):
    """The file system of a path as Spark names it, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# Writing


def revisits(pages: DataFrame, page_id: str, payload: str, least: int) -> DataFrame:
    """(page id, digest) of the rows to write as revisits, and the id they refer to."""
    body = F.coalesce(column(pages, payload), F.lit("")).cast("binary")
    narrow = written(
        pages.select(column(pages, page_id).alias("id"), F.sha1(body).alias("digest"),
                     F.octet_length(body).alias("size"))
        .filter(F.col("size") >= least),
        "digests",
    )
    repeated = (
        narrow.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("kept"))
        .filter("copies > 1")
    )
    repeated = written(repeated, "repeated-digests")
    found = heavy_split(narrow, repeated, "digest", "copies", narrow.count())
    # A row without an id sorts first; an id may occur in several rows.
    return (
        found.filter("kept IS NOT NULL AND (id IS NULL OR id < kept)")
        .select("id", "digest", "kept").distinct()
    )


def _header(pairs: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in pairs if v is not None), "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass")


def _record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    name = "" if page is None else page
    return _header([
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else f"<{_ID}{refers_to}>"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]) + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
    payload: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write a record per row into archives under ``folder``; returns the list of archives.

    Of rows with equal payloads of at least ``least`` bytes those with the largest
    id are responses; the others are revisits that refer to it. Null payloads are
    empty. Rows that repeat an id give a record each. A task writes an archive under
    a name of its attempt and renames it when it is whole, so a task that is run
    again replaces its archives and leaves none half written. Only listed archives count.
    """
    spark = pages.sparkSession
    body = F.coalesce(column(pages, payload), F.lit("")).cast("binary")
    rows = pages.select(
        column(pages, page_id).alias("id"), column(pages, url).alias("url"),
        body.alias("payload"), F.sha1(body).alias("digest"),
    )
    marked = revisits(pages, page_id, payload, least)
    joined = rows.join(
        marked, rows["id"].eqNullSafe(marked["id"]) & (rows["digest"] == marked["digest"]), "left"
    ).select(rows["id"], "url", "payload", rows["digest"], "kept")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, place = _file_system(folder)
        system.create_dir(place, recursive=True)
        listed, out = [], None

        def close():
            out.close()
            system.move(listed[-1][2], listed[-1][0])

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                member = _member(_record(*row), level)
                if out is None or listed[-1][1] + len(member) > archive_bytes:
                    if out is not None:
                        close()
                    name = f"{place}/part-{context.partitionId():05d}-{len(listed):04d}.warc.gz"
                    listed.append([name, 0, f"{name}.{context.taskAttemptId()}"])
                    out = system.open_output_stream(listed[-1][2], compression=None)
                out.write(member)
                listed[-1][1] += len(member)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n.rsplit('/', 1)[1]}" for n, _, _ in listed], pa.string()),
             pa.array([s for _, s, _ in listed], pa.int64())],
            ["path", "length"],
        )

    return written(joined.mapInArrow(write, "path string, length bigint"), "archives")


# Reading

_RECORD = (
    "path string, offset bigint, length bigint, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes bigint, "
    "payload binary"
)


class _Window:
    """A file read in order from any offset, a chunk at a time."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size, self.start, self.data = source, size, start, b""

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        self.data += self.source.read(min(max(CHUNK, len(self.data)), self.size - at))
        return True

    def skip(self, to: int) -> None:
        """Forget what lies before ``to``."""
        self.data = self.data[to - self.start :]
        self.start = to

    def find(self, end: int) -> int | None:
        """The first gzip magic that begins in [start, end)."""
        while True:
            at = self.data.find(MAGIC)
            if at >= 0:
                return self.start + at if self.start + at < end else None
            self.skip(max(self.start, self.start + len(self.data) - len(MAGIC) + 1))
            if self.start >= end or not self.more():
                return None

    def member(self) -> tuple[bytes, int] | None:
        """The whole WARC record that begins at ``start`` and its length in the file.

        None if what begins here does not decode, does not open with a WARC
        header or fails the member's checksum.
        """
        unpack, out, at, checked = zlib.decompressobj(31), [], 0, False
        have = 0
        while not unpack.eof:
            if at >= len(self.data) and not self.more():
                return None
            piece = self.data[at : at + CHUNK]
            at += len(piece)
            try:
                out.append(unpack.decompress(piece))
            except zlib.error:
                return None
            have += len(out[-1])
            if not checked and have >= 6:
                if not b"".join(out)[:6] == b"WARC/1":
                    return None
                checked = True
        return (b"".join(out), at - len(unpack.unused_data)) if checked else None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _parse(record: bytes) -> tuple | None:
    head, found, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    if not found or not fields.get("content-length", "").isdigit():
        return None
    block = rest[: int(fields["content-length"])]
    http, split, payload = block.partition(b"\r\n\r\n")
    if "application/http" not in fields.get("content-type", "") or not split:
        http, payload = b"", block
    size = _fields(http).get("content-length", "") if http else ""
    revisit = fields.get("warc-type") == "revisit"
    digest = fields.get("warc-payload-digest")
    if digest and digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    strip = lambda v: v.strip("<>") if v else None
    return (
        fields.get("warc-type"), strip(fields.get("warc-record-id")),
        strip(fields.get("warc-refers-to")), fields.get("warc-target-uri"), digest,
        int(size) if revisit and size.isdigit() else len(payload),
        None if revisit else payload,
    )


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple]:
    """Records that begin in [start, end) of an open file, with offset and length."""
    window = _Window(source, size, start)
    while True:
        at = window.find(end)
        if at is None:
            return
        window.skip(at)
        found = window.member()
        parsed = _parse(found[0]) if found else None
        if parsed is None:
            window.skip(at + 1)
            continue
        yield at, found[1], *parsed
        window.skip(at + found[1])


def read_warc(archives: DataFrame, split_bytes: int | None = SPLIT_BYTES) -> DataFrame:
    """The records of gzip archives given as (path, length).

    Archives are read in ranges of ``split_bytes``, each by one task, which holds one
    record and a chunk of the file at a time. A revisit has no payload, but the digest
    and size of the one it refers to. Bytes that are no valid record are passed over
    and reading goes on at the next one. A payload that itself holds a whole gzip
    archive which gzip could not shrink may be taken for records where a range begins
    inside it; ``split_bytes=None`` reads each archive from its start and is safe from that.
    """
    spark = archives.sparkSession
    step = F.lit(split_bytes) if split_bytes else F.greatest(F.col("length"), F.lit(1))
    ranges = written(
        archives.filter("length > 0").select(
            "path", "length",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long")))
            .alias("start"),
        ).withColumn("end", F.least(F.col("length"), F.col("start") + step)),
        "ranges",
    )
    parts = max(1, min(ranges.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = _file_system(path)
                with system.open_input_file(place) as source:
                    held, weight = [], 0
                    for found in records_in(source, size, start, end):
                        held.append((path, *found))
                        weight += len(found[-1] or b"")
                        if weight > 4 << 20 or len(held) >= 5000:
                            yield _rows(held)
                            held, weight = [], 0
                    if held:
                        yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        names = [f.split()[0] for f in _RECORD.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*held), kinds)], names
        )

    # Neighbouring ranges go to different tasks.
    return ranges.repartition(parts).mapInArrow(read, _RECORD)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in a folder as (path, length), without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "length")


def _page(record_id: str) -> Column:
    return F.expr(f"try_cast(substring({record_id}, {len(_ID) + 1}) AS bigint)")


def op3_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages into archives and read them back by byte ranges."""
    archives = write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    found = read_warc(archives)
    response = F.col("record_type") == "response"
    return found.select(
        _page("record_id").alias("page_id"),
        "payload_bytes",
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
