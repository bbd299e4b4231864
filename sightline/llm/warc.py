"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of
frames followed by a skippable frame with the seek table (sizes and checksum
of every frame) and its footer, so a reader can find and decode one frame
without the others. Each bundle carries an index that maps record identifiers
to (frame, offset within the decoded frame, length).

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest page id is a ``response`` with the payload, the others are
``revisit`` records that refer to it. Bundles are rows of a table that Spark
writes (``bundle_id, content, entries``), so a lost executor or a repeated
task cannot leave half a file; ``export`` copies them out as ``.warc.zst``
files.

Defined cases: null html is the empty payload; null url writes no target URI,
control characters in a url are percent-encoded; a null page id never is the
smallest, its record carries no page id and refers to the group's response if
there is one; repeated rows with the smallest page id are all responses, and
share their record identifier; an empty table writes no bundle; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
# bundles are compressed already; small row groups keep a reader's memory small
TABLE_OPTIONS = {"compression": "none", "parquet.block.size": 16 << 20}
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = T.StructType([
    T.StructField("bundle_id", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("record_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("frame_offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]))),
])
RECORD_SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()),
])


def typed_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, and refers_to for revisits.

    Payload groups are counted with a map-side combined aggregation; only
    groups of two or more meet the pages again.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    keys = base.where(F.octet_length("payload") >= min_revisit)
    groups = (
        keys.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first"))
        .where("_n > 1")
        .select(F.col("digest").alias("_digest"), "_first")
    )
    later = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return base.join(groups, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(later, F.col("_first")).alias("refers_to")
    )


def record_id(page_id: int | None, digest: str) -> str:
    name = hashlib.sha256(f"{page_id}:{digest}".encode()).digest()[:16]
    return f"urn:uuid:{uuid.UUID(bytes=name, version=5)}"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <{record_id(refers_to, digest)}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` and the offset after it. Payload size and
    digest are those of the bytes read for a response, and the recorded ones
    of the full payload for a revisit."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:http_end].decode().split("\r\n")[1:])
    payload = block[http_end + 4 :]
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest mismatch")
    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
    record = {
        "record_id": head["WARC-Record-ID"].strip("<>"),
        "page_id": int(page) if page is not None else None,
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "refers_to": int(refers) if refers is not None else None,
    }
    return record, end + 4 + int(head["Content-Length"]) + 4


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, bundle_id: str):
        self.bundle_id = bundle_id
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.entries: list[dict] = []
        self.raw = 0
        self._open = bytearray()

    def add(self, rid: str, record: bytes) -> None:
        if self._open and len(self._open) + len(record) > FRAME_BYTES:
            self._close_frame()
        self.entries.append({
            "record_id": rid, "frame": len(self.frames), "frame_offset": len(self._open), "length": len(record)
        })
        self._open += record
        self.raw += len(record)

    def _close_frame(self) -> None:
        data = bytes(self._open)
        frame = zstandard.ZstdCompressor(level=LEVEL).compress(data)
        self.frames.append(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._open.clear()

    def finish(self) -> dict:
        if self._open:
            self._close_frame()
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        content = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body
        return {"bundle_id": self.bundle_id, "content": content, "entries": self.entries}


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame, read from the
    end of the bundle."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
        raise ValueError("no seek table")
    rows, offset = [], 0
    start = len(content) - 9 - 12 * count
    for packed, size, check in struct.iter_unpack("<III", content[start:-9]):
        rows.append((offset, packed, size, check))
        offset += packed
    return rows


def read_frame(content: bytes, row: tuple[int, int, int, int]) -> bytes:
    offset, packed, size, check = row
    data = zstandard.ZstdDecompressor().decompress(content[offset : offset + packed], max_output_size=size)
    if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("frame checksum mismatch")
    return data


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _write_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema, part, serial, writer = _arrow(BUNDLE_SCHEMA), TaskContext.get().partitionId(), 0, None
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
        for i in range(batch.num_rows):
            page, url, payload, digest, refers = (c[i].as_py() for c in columns)
            if writer is None:
                writer = BundleWriter(f"bundle-{part:06d}-{serial:06d}")
            writer.add(record_id(page, digest), build_record(page, url, payload, digest, refers))
            if writer.raw >= BUNDLE_BYTES:
                yield pa.RecordBatch.from_pylist([writer.finish()], schema)
                writer, serial = None, serial + 1
    if writer is not None:
        yield pa.RecordBatch.from_pylist([writer.finish()], schema)


def bundles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Bundles of all pages: one row per bundle of about ``BUNDLE_BYTES``."""
    return typed_records(pages, min_revisit).mapInArrow(_write_partition, BUNDLE_SCHEMA)


def index(bundle_table: DataFrame) -> DataFrame:
    """record_id -> bundle, frame, offset in the decoded frame, length."""
    return bundle_table.select("bundle_id", F.explode("entries").alias("e")).select("bundle_id", "e.*")


def _read_partition(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = _arrow(RECORD_SCHEMA)
    for batch in batches:
        for value in batch.column("content"):
            content = value.as_py()
            for row in seek_table(content):
                data, at, found = read_frame(content, row), 0, []
                while at < len(data):
                    record, at = parse_record(data, at)
                    if not payloads:
                        record["payload"] = None
                    found.append(record)
                yield pa.RecordBatch.from_pylist(found, schema)


def read_all(bundle_table: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, frame by frame; ``payloads=False`` checks
    the payloads but does not return them."""
    return bundle_table.select("content").mapInArrow(lambda b: _read_partition(b, payloads), RECORD_SCHEMA)


def _fetch_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(RECORD_SCHEMA)
    for batch in batches:
        for row in batch.to_pylist():
            table, found = seek_table(row["content"]), []
            for e in sorted(row["wanted"], key=lambda e: (e["frame"], e["frame_offset"])):
                data = read_frame(row["content"], table[e["frame"]])
                found.append(parse_record(data[e["frame_offset"] : e["frame_offset"] + e["length"]])[0])
            yield pa.RecordBatch.from_pylist(found, schema)


def fetch(bundle_table: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records with the given ``record_id`` values, by index: only the
    frames that hold them are decoded."""
    at = index(bundle_table).join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    wanted = at.groupBy("bundle_id").agg(F.collect_list(F.struct("frame", "frame_offset", "length")).alias("wanted"))
    return bundle_table.join(wanted, "bundle_id").select("content", "wanted").mapInArrow(_fetch_partition, RECORD_SCHEMA)


def export(bundle_table: DataFrame, directory: str) -> None:
    """Copy each bundle to ``<directory>/<bundle_id>.warc.zst`` on a file
    system all executors share. A repeated task rewrites the same file."""

    def copy(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        for row in rows:
            final = f"{root}/{row.bundle_id}.warc.zst"
            part = f"{final}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(bytes(row.content))
            store.move(part, final)

    bundle_table.select("bundle_id", "content").foreachPartition(copy)
