"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  A reading task owns a byte range: it
scans for the gzip magic, takes a candidate only if its first bytes decompress
to a WARC header, and reads on from member to member.  It owns the records that
start inside its range, and reads past the end for the last of them.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, written
from .lookup import filesystem
from .names import col
from .skew import dealt_join

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_READ = 1 << 20

# --------------------------------------------------------------------------- writing


def record(kind: str, record_id: str, uri: str, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None, level: int) -> bytes:
    """One record as a gzip member.  The block is an HTTP response head and, unless a revisit, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_urn(page_id: int | None) -> str:
    return f"urn:tarn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2020-01-01T00:00:00Z", level: int = 5, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record per row of ``pages``; a table of the archives written: path, bytes, records.

    The payload is the html in UTF-8, null counts as empty.  Of the rows whose
    payloads of ``least`` bytes or more are equal, those with the largest
    page_id are response, the others revisit it (one with a null page_id
    too, unless all ids are null; then all are response).  An id that is no
    integer counts as null.  Smaller payloads are always response.  A null url becomes ``urn:tarn:unknown``.  An empty table
    gives no archive.

    A task writes files under names that no other attempt uses, and only the
    returned table, which Spark commits, says which files count; so tasks may
    fail and run again.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.coalesce(col(html), F.lit(""))
    rows = pages.select(col(page_id).try_cast("long").alias("page_id"), col(url).alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    copies = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1")
    # written, so that the planner knows its size and broadcasts it only if it is small
    copies = written(copies, "copies")
    rows = dealt_join(rows, copies, ["digest", "size"], "n", ["page_id", "url"], pages.count(), "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.select("page_id", "url", "digest", "size", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for r in batch.slice(a, 64).to_pylist():
                    if out is None:
                        path, size, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        system, place = filesystem(path)
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(place, compression=None)
                    uri = quote(r["url"], safe="!#$%&'()*+,/:;=?@[]~") if r["url"] is not None else "urn:tarn:unknown"
                    old = r["refers_to"]
                    data = record("response" if old is None else "revisit", page_urn(r["page_id"]), uri, date, r["digest"], r["size"], None if old is not None else r["html"].encode(), None if old is None else page_urn(old), level)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= file_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return written(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


# --------------------------------------------------------------------------- reading


class _Source:
    """A file read forward in pieces, from ``start``; what was read and not yet skipped is ``data[off:]``."""

    def __init__(self, uri: str, start: int) -> None:
        system, place = filesystem(uri)
        self.file = system.open_input_file(place)
        self.file.seek(start)
        self.at = start  # the place in the file of data[off]
        self.data, self.off = b"", 0

    def __len__(self) -> int:
        return len(self.data) - self.off

    def more(self, n: int = _READ) -> bool:
        got = self.file.read(n)
        self.data, self.off = self.data[self.off :] + got, 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.off += n
        self.at += n

    def starts(self, mark: bytes) -> bool:
        return self.data.startswith(mark, self.off)

    def close(self) -> None:
        self.file.close()


def _header_at(source: _Source, i: int) -> bool:
    """Whether a gzip member whose text starts like a WARC header begins ``i`` bytes ahead."""
    while len(source) < i + 4096 and source.more():
        pass
    unpacker = zlib.decompressobj(31)
    try:
        head = unpacker.decompress(source.data[source.off + i : source.off + i + 4096], 64)
    except zlib.error:
        return False
    return head.startswith(VERSION)


def _member(source: _Source) -> bytes | None:
    """The text of the member that begins here, which it skips; None if it is broken."""
    unpacker = zlib.decompressobj(31)
    parts, used = [], 0
    if not len(source):
        source.more()
    while True:
        view = memoryview(source.data)[source.off + used :]
        try:
            # in slices, so that bytes after the member are not copied over and over
            for a in range(0, len(view), 1 << 16):
                parts.append(unpacker.decompress(view[a : a + (1 << 16)]))
                if unpacker.eof:
                    source.skip(used + min(len(view), a + (1 << 16)) - len(unpacker.unused_data))
                    return b"".join(parts)
        except zlib.error:
            return None
        used = len(source)
        if not source.more():
            return None


def read_range(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of every record that starts in [start, end).

    A candidate counts if its header decodes, it decompresses to its end with
    the right checksum, and the file ends there or another member follows.
    Broken stretches are skipped up to the next such candidate.
    """
    source = _Source(uri, start)
    sure = start == 0
    try:
        while source.at < end:
            if not sure:
                i = source.data.find(MAGIC, source.off) - source.off
                if i < 0:
                    source.skip(max(0, len(source) - (len(MAGIC) - 1)))
                    if not source.more():
                        return
                    continue
                if not _header_at(source, i):
                    source.skip(i + 1)
                    continue
                source.skip(i)
                if source.at >= end:
                    return
            at = source.at
            if not len(source) and not source.more():
                return
            while len(source) < len(MAGIC) and source.more():
                pass
            text = _member(source) if source.starts(MAGIC) else None
            follows = False
            if text is not None:
                while len(source) < len(MAGIC) and source.more():
                    pass
                follows = not len(source) or source.starts(MAGIC)
            if text is None or not text.startswith(VERSION) or not (follows or sure):
                source.close()
                source = _Source(uri, at + 1)
                sure = False
                continue
            yield at, text
            sure = follows
    finally:
        source.close()


def _number(text: str | None) -> int | None:
    """A length as archives write it; None if it is none."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def sha1_of(label: str) -> str | None:
    """The hex SHA-1 of a digest label, whose value is hex or base 32, in either case; None if it is neither."""
    name, _, value = label.partition(":")
    if name.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    try:
        return bytes.fromhex(value).hex() if len(value) == 40 else base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except ValueError:
        return None


def parse_record(text: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's fields, the HTTP head's fields (names in lower case) and the payload.

    Without a readable Content-Length the block is all that follows the header.
    """

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}

    head, _, rest = text.partition(b"\r\n\r\n")
    warc = fields(head)
    length = _number(warc.get("content-length"))
    block = rest[:length] if length is not None else rest.removesuffix(b"\r\n\r\n")
    if "application/http" not in warc.get("content-type", ""):
        return warc, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(head), payload


_RECORDS = "path string, position long, record_type string, record_id string, target_uri string, digest string, refers_to string, content_length long, payload binary"


def read_warc(spark: SparkSession, archives: DataFrame | str, split_bytes: int = 16 << 20) -> DataFrame:
    """One row per record: path, position, record_type, record_id, target_uri, digest (SHA-1, hex), refers_to, content_length, payload.

    ``archives`` is a table (path, bytes) or a folder or glob.  ``content_length``
    is that of the HTTP head, so of the full payload also for revisits, which
    have no payload here (null).  A record that isn't HTTP has its block as payload.
    A digest that is no SHA-1 in hex or base 32 is null, a length that is no
    number counts as that of what is there.
    """
    if isinstance(archives, str):
        archives = spark.read.format("binaryFile").load(archives).select("path", F.col("length").alias("bytes"))
    step = F.lit(split_bytes)
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step.cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + step).alias("stop"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def urn(field: str | None) -> str | None:
        return field.strip("<>") if field else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for at, text in read_range(r["path"], r["start"], r["stop"]):
                    warc, http, payload = parse_record(text)
                    kind = warc.get("warc-type")
                    digest = sha1_of(warc.get("warc-payload-digest", ""))
                    length = _number(http.get("content-length"))
                    length = len(payload) if length is None else length
                    rows.append((r["path"], at, kind, urn(warc.get("warc-record-id")), warc.get("warc-target-uri"), digest, urn(warc.get("warc-refers-to")), length, None if kind == "revisit" else payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ranges.mapInArrow(run, _RECORDS)


def page_of(urn):
    """The page_id in a record's name, null if it has none."""
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '^urn:tarn:page:(-?[0-9]+)$', 1), '') as bigint)")
