"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, followed by a
skippable frame with the seek table of the public seekable format: compressed and decompressed size
of every frame, then the number of frames, a descriptor byte and a magic number. The index written
beside the bundles maps each record to (bundle, frame, offset in the frame, length), so one record is
read by one ranged read and one frame's decompression.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem, fresh_path, local_path, materialize
from .batches import bound_batches

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which a frame, and bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24

INDEX = "page_id long, bundle string, frame int, frame_at long, frame_size long, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: line ends and percent signs are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def make_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or, given ``refers_to``, a revisit record without it."""
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_line(url)}")
    headers.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    headers.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = payload if refers_to is None else b""
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, Any], bytes, int]:
    """(headers, payload, position after it) of the record at ``at``; ValueError on damage."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    payload = data[head + 4 : head + 4 + size]
    if headers["WARC-Type"] == "response" and "sha1:" + digest(payload) != headers["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    return headers, payload, head + 4 + size + 4


class BundleWriter:
    """Frames and footer of one bundle, in memory (bounded by BUNDLE_BYTES or one record)."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.body, self.table = frame_bytes, bytearray(), []
        self.open, self.held, self.index = bytearray(), [], []
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.close_frame()
        self.held.append((page_id, len(self.open), len(record)))
        self.open += record

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(bytes(self.open))
            self.index += [(p, len(self.table), len(self.body), len(frame), o, n) for p, o, n in self.held]
            self.table.append((len(frame), len(self.open)))
            self.body += frame
            self.open, self.held = bytearray(), []

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(read_at, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed size) of the frames of a bundle of ``size`` bytes;
    ``read_at(start, length)`` reads from it."""
    count, _, magic = struct.unpack("<IBI", read_at(size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table, at = read_at(size - 9 - 8 * count, 8 * count), 0
    out = []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def bundle_frames(source) -> Iterator[bytes]:
    """The decompressed frames of an open pyarrow file, one at a time."""
    def read_at(start: int, length: int) -> bytes:
        source.seek(start)
        return source.read(length)

    for start, packed, plain in seek_table(read_at, source.size()):
        yield zstandard.ZstdDecompressor().decompress(read_at(start, packed), max_output_size=max(plain, 1))


def records_of(frame: bytes) -> Iterator[tuple[dict[str, Any], bytes]]:
    at = 0
    while at < len(frame):
        headers, payload, at = read_record(frame, at)
        yield headers, payload


def _urn(value: str | None) -> int | None:
    if value is None or value == "<urn:page:None>":
        return None
    return int(value.removeprefix("<urn:page:").removesuffix(">"))


def revisit_plan(pages: DataFrame, page_id: str, html: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` as (page_id, url, payload, last): last is the largest page_id of the pages with an
    equal payload of at least ``min_bytes`` bytes, null where the payload occurs once.

    Only digests cross the wire for the count. Payloads that occur often enough to fill a task (over
    a thousandth of all pages, so at most a thousand) are matched by broadcast; the rest by a join."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sum", F.sha1("payload"))
    groups = materialize(rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sum").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")), "digests")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    repeated = groups.filter("copies > 1")
    often = F.col("copies") > F.lit(total / 1000 + 1)
    hot = F.broadcast(repeated.filter(often).select(F.col("sum").alias("hot_sum"), F.col("last").alias("hot_last")))
    rest = repeated.filter(~often).select(F.col("sum").alias("rest_sum"), F.col("last").alias("rest_last"))
    rows = rows.join(hot, F.col("sum") == F.col("hot_sum"), "left")
    # A matched row gets a key of its own, so that the second join never gathers a hot payload.
    key = F.when(F.col("hot_sum").isNull(), F.col("sum")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")))
    rows = rows.withColumn("key", key).join(rest, F.col("key") == F.col("rest_sum"), "left")
    return rows.select("page_id", "url", "payload", F.coalesce("hot_last", "rest_last").alias("last"))


def write_warc(pages: DataFrame, folder: str, *, page_id: str = "page_id", html: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one WARC record a row of ``pages`` into bundles under ``folder``; returns the index.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``min_bytes`` bytes
    the row with the largest page_id is the response (every one of them, where rows repeat it), the
    others revisit it; a row without page_id never is referred to and, if its payload has others,
    revisits them. An empty table writes no bundle. A url is optional; line ends in it are encoded.
    A task that is run again writes bundles under new names, and the index, which Spark commits,
    names only those of the attempts that counted."""
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))

    bound_batches(pages.sparkSession)

    def write(batches):
        store, root = filesystem(folder)
        writer, out = BundleWriter(frame_bytes), []

        def close():
            name = f"{root}/bundle-{uuid.uuid4().hex}.warc.zst"
            data = writer.finish()
            with store.open_output_stream(name, compression=None) as f:
                f.write(data)
            uri = name if local_path(folder) is not None else folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]
            columns = list(zip(*writer.index)) or [[]] * 6
            names = pa.array([uri] * len(writer.index), pa.string())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cells = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([cells[0], names, *cells[1:]], ["page_id", "bundle", "frame", "frame_at", "frame_size", "offset", "length"])

        for batch in batches:
            for row_id, url, payload, last in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "last"))):
                ident, refers = row_id.as_py(), last.as_py()
                writer.add(ident, make_record(ident, url.as_py(), payload.as_py(), None if refers is None or refers == ident else refers))
                if len(writer.body) + len(writer.open) >= bundle_bytes:
                    yield close()
                    writer = BundleWriter(frame_bytes)
        if writer.body or writer.open:
            yield close()

    plan = revisit_plan(pages, page_id, html, min_bytes)
    return materialize(plan.mapInArrow(write, INDEX), "warc-index")


#: Tasks that read bundles, at most; each reads its bundles one after another.
READERS = 20_000


def read_warc(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read through their seek tables.

    (page_id, url, record_type, refers_to, payload_bytes, payload_digest); the last two are those of
    the full payload for revisits too. A damaged payload raises an error."""
    bundles = materialize(index.select("bundle").distinct(), "bundles")
    bundles = bundles.repartition(max(1, min(bundles.count(), READERS)))  # a few names would be one task

    def read(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                store, path = filesystem_of(uri)
                with store.open_input_file(path) as source:
                    for frame in bundle_frames(source):
                        rows = [(_urn(h["WARC-Record-ID"]), _unline(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, h["WARC-Type"], _urn(h.get("WARC-Refers-To")), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")) for h, _ in records_of(frame)]
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return bundles.mapInArrow(read, RECORDS)


def filesystem_of(uri: str):
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the records of ``wanted`` (page_id), each by one ranged read of its frame."""
    hits = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")

    def fetch(batches):
        for batch in batches:
            ids, payloads = [], []
            for r in batch.to_pylist():
                store, path = filesystem_of(r["bundle"])
                with store.open_input_file(path) as source:
                    source.seek(r["frame_at"])
                    frame = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(r["frame_size"]))
                ids.append(r["page_id"])
                payloads.append(read_record(frame[r["offset"] : r["offset"] + r["length"]])[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], ["page_id", "payload"])

    return hits.mapInArrow(fetch, "page_id long, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages and report what the archives hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_warc(pages, fresh_path(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
