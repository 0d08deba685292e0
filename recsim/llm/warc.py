"""WARC archives: a writer with revisit records and a sequential reader.

Writing: records are gzip members made by tasks, one per page, and Spark's own text
writer puts them into files (any Hadoop file system, commit protocol included).  The
writer's line separator is an empty gzip member, so a file is a plain concatenation of
members and any WARC tool can read it.

Reading: ``binaryFile`` gives a task the bytes of one archive, whose size and record count are
bounded by the writer.  The reader inflates it in small steps, one member at a time; the
record's content length frames the bytes as they come, and the block and payload digests are
taken on the way.  A payload is held only where it is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsim.llm.common import ship
from recsim.sources.files import scratch_path

#: Records of one archive at most.
RECORDS_PER_FILE = 1000
#: Bytes of one archive at most; a longer member is an archive of its own.
BYTES_PER_FILE = 16 << 20
#: Bytes given to the inflater at a time, bytes it gives back at most, bytes of a record's head at most.
STEP, INFLATED, HEAD = 1 << 16, 1 << 20, 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ship(__name__)


class WarcError(ValueError):
    """A record that breaks the framing or fails a digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(page_id: int) -> str:
    """A version 8 UUID that holds the page's 64-bit id (62 bits low, 2 bits in the middle)."""
    n = page_id & (1 << 64) - 1
    return str(uuid.UUID(int=8 << 76 | (n >> 62) << 64 | 2 << 62 | n & (1 << 62) - 1))


def page_of(record_id: str) -> int:
    n = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    n = (n >> 64 & 3) << 62 | n & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member without time stamp, so that a task run again writes the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = member(b"", 9)


def make_record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record: ``response`` with the payload, or ``revisit`` with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:uuid:{record_uuid(page_id)}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", " ".join(url.split()))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:uuid:{record_uuid(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def inflated(data, step: int = STEP):
    """(bytes, whether the member ends) of gzip members, read ``step`` bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = view[at:at + step]
            out = z.decompress(piece, INFLATED)
            if not len(piece) and not out and not z.eof:
                raise WarcError("the archive ends inside a member")
            at += len(piece) - len(z.unused_data if z.eof else z.unconsumed_tail)
            yield out, z.eof


def members(data, step: int = STEP):
    """The inflated bytes of each non-empty gzip member."""
    out: list[bytes] = []
    for piece, ends in inflated(data, step):
        out.append(piece)
        if ends:
            if record := b"".join(out):
                yield record
            out = []


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


class Record:
    """A record read piece by piece: its Content-Length frames the block, digests are taken as bytes pass."""

    def __init__(self, keep: bool = True):
        self.begun = self.tail = b""
        self.fields: dict | None = None             # of the record
        self.http: dict | None = None               # of the block
        self.block, self.body, self.size = hashlib.sha1(), hashlib.sha1(), 0
        self.payload: list | None = [] if keep else None

    def _head(self, data: bytes) -> tuple[dict | None, bytes]:
        """(fields, what follows them) once the head is whole."""
        self.begun += data
        head, sep, rest = self.begun.partition(b"\r\n\r\n")
        if not sep:
            if len(self.begun) > HEAD:
                raise WarcError("no end of the head")
            return None, b""
        self.begun = b""
        return _fields(head), rest

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            if not b"WARC/".startswith((self.begun + data)[:5]):
                raise WarcError("no WARC head")
            self.fields, data = self._head(data)
            if self.fields is None:
                return
            self.left = int(self.fields["content-length"])
        block, after = data[:self.left], data[self.left:]
        self.left -= len(block)
        self.tail += after
        if len(self.tail) > 4:
            raise WarcError("the block does not have its stated length")
        self.block.update(block)
        if self.http is None:
            self.http, block = self._head(block)
        self.body.update(block)
        self.size += len(block)
        if self.payload is not None:
            self.payload.append(block)

    def close(self) -> dict:
        """The record's columns, verified."""
        def base32(digest) -> str:
            return base64.b32encode(digest.digest()).decode()

        f = self.fields
        if f is None or self.left or self.tail != b"\r\n\r\n":
            raise WarcError("the record does not have its stated length")
        if f["warc-block-digest"] != f"sha1:{base32(self.block)}":
            raise WarcError("block digest")
        if self.http is None:
            raise WarcError("no HTTP head")
        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
        length = int(self.http["content-length"])
        if kind == "response" and (self.size != length or base32(self.body) != digest):
            raise WarcError("payload digest")
        refers = f.get("warc-refers-to")
        return {"page_id": page_of(f["warc-record-id"]), "url": f["warc-target-uri"], "record_type": kind, "payload_digest": digest,
                "payload_bytes": length, "refers_to": None if refers is None else page_of(refers),
                "payload": b"".join(self.payload) if kind == "response" and self.payload is not None else None}


def parse_record(data: bytes) -> dict:
    record = Record()
    record.feed(data)
    return record.close()


def read_records(data, payloads: bool = True, step: int = STEP):
    """Every record of an archive, one at a time; empty members lie between them."""
    record = None
    for piece, ends in inflated(data, step):
        if piece:
            record = record or Record(payloads)
            record.feed(piece)
        if ends and record is not None:
            yield record.close()
            record = None


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE,
               bytes_per_file: int = BYTES_PER_FILE) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``path``, in archives of at most
    ``records_per_file`` records and ``bytes_per_file`` bytes (more only if one record is longer).

    Among rows with equal payloads (by SHA-1) of at least ``min_bytes`` bytes the row with the
    smallest page_id is a response and the others revisit it; rows that repeat that smallest
    id are all responses, as are all shorter payloads.  A null html is empty, a null url too.
    Rows without page_id are left out: a record must have an id.  Other columns are not
    read.  An empty table gives archives without records.
    """
    rows = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    first = (rows.where(F.length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    revisits = rows.select("page_id", "sha").join(first, "sha").where("page_id <> first").select("page_id", "sha", "first").distinct()
    dealt = rows.join(revisits, ["page_id", "sha"], "left")

    def pack(batches):
        """One row per archive: the members of consecutive records."""
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            for k in range(batch.num_rows):
                data = member(make_record(*(batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "first"))))
                if held and (len(held) == records_per_file or size + len(data) > bytes_per_file):
                    yield archive()
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield archive()

    (dealt.select("page_id", "url", "payload", "first").mapInArrow(pack, "value binary")
     .select(F.col("value").cast("string"))
     .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", 1).text(path))


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``: page_id, url, record_type, payload_digest,
    payload_bytes, refers_to and, with ``payloads``, the payload (null for revisits)."""
    schema = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                       ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    if not payloads:
        types = types.remove(6)

    def scan(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in read_records(content.as_buffer(), payloads):
                    rows.append({k: row[k] for k in types.names})
                    size += len(row["payload"] or b"")
                    if len(rows) == 256 or size > BYTES_PER_FILE:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(scan, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared checkpoint folder and reads the records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path, payloads=False)
