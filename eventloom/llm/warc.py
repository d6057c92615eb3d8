"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run
of frames with the public seek-table footer (skippable frame 0x184D2A5E, magic
0x8F92EAB1), so standard tools can open it. An index maps each record to its
bundle, its frame and its offset inside the decompressed frame.

A bundle travels as one row (bounded by ``BUNDLE_BYTES`` plus one record) of a
table in the shared folder: Spark's commit protocol makes a retried task
replace its own bundles, and any store that Spark can write will do.

Defined results: null html is an empty payload; payloads under
``REVISIT_BYTES`` are always responses; of equal larger payloads the rows with
the largest page_id are responses and the rest revisit it; a null page_id never
wins against another id; null urls leave the target out; repeated rows give
repeated records; extra columns are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import own_folder

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
REVISIT_BYTES = 1000
#: Fixed values of the seekable format and of the record format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_bytes(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    body = HTTP % size + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload as stored, and the payload's full size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields, payload, size


class BundleWriter:
    """Gathers records into frames, frames into one archive."""

    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.filled, len(record)))
        self.open.append(record)
        self.filled += len(record)
        self.total += len(record)
        if self.filled >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append(self.zip.compress(raw))
            self.sizes.append((len(self.frames[-1]), len(raw)))
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and raw size of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, found = 0, []
    for packed, raw in struct.iter_unpack("<II", archive[-9 - 8 * n : -9]):
        found.append((at, packed, raw))
        at += packed
    return found


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=raw)


def typed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Key, url, payload, size, digest and refers_to (null for responses).

    The largest key of each group of equal payloads comes from a partially
    aggregated groupBy; only groups of two or more join back, and AQE can split
    that join where one payload holds a large share of the rows.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    first = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "winner")
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("winner")).alias("refers_to"))


def pack(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles with their index, from the rows of ``typed``."""
    schema = "bundle_id string, archive binary, record_index array<struct<record_id:string,frame:int,frame_offset:int,length:int>>"
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int32()), ("length", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, n, out = TaskContext.get().partitionId(), 0, BundleWriter()

        def flush(w: BundleWriter) -> pa.RecordBatch:
            index = [dict(zip(("record_id", "frame", "frame_offset", "length"), x, strict=True)) for x in w.index]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([w.finish()], pa.binary()), pa.array([index], kind)], names=["bundle_id", "archive", "record_index"])

        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                out.add("" if page_id is None else str(page_id), record_bytes(page_id, url, payload, size, digest, refers_to, date))
                if out.total >= BUNDLE_BYTES:
                    yield flush(out)
                    n, out = n + 1, BundleWriter()
        if out.index:
            yield flush(out)

    return records.mapInArrow(run, schema)


def unpack(bundles: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Every record of the bundles, read through index and seek table.

    The digest of a response is worked out anew from the payload read back; a
    mismatch with its header fails the task.
    """
    schema = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary"
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def bare(urn: str | None) -> str | None:
        return None if urn is None else urn[len("<urn:page:") : -1] or None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0), batch.column(1), strict=True):
                archive, rows, held, frame = archive.as_py(), [], None, b""
                table = seek_table(archive)
                for entry in index.as_py():
                    if entry["frame"] != held:
                        held, frame = entry["frame"], read_frame(archive, table[entry["frame"]])
                    fields, payload, size = parse_record(frame[entry["frame_offset"] : entry["frame_offset"] + entry["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {entry['record_id']} does not match its digest")
                    rows.append((bare(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], bare(fields.get("WARC-Refers-To")), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = bundles.select("archive", "record_index").mapInArrow(run, schema)
    return out.select(F.col("id").cast(key_type).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(key_type).alias("refers_to"), "payload")


def write_archives(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write the bundles of ``pages`` to ``path`` (else a new folder in the shared one); gives the path."""
    path = path or own_folder(pages.sparkSession, "warc")
    pack(typed(pages, **columns)).write.option("compression", "uncompressed").parquet(path)
    return path


def fetch(bundles: DataFrame, record_ids: list[str]) -> DataFrame:
    """The bundles' rows that hold any of a given short list of records, with only those in the index."""
    wanted = F.array(*[F.lit(x) for x in record_ids])
    kept = F.filter("record_index", lambda x: F.array_contains(wanted, x["record_id"]))
    return bundles.withColumn("record_index", kept).where(F.size("record_index") > 0)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a record per row, read the archives back, one row per record."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    return unpack(spark.read.parquet(write_archives(pages, path)), kind)
