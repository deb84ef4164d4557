"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import os
import struct
import uuid
from collections import OrderedDict

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.shared import HOT_KEYS, shared_dir, written
from groundq.shipping import ship

# Fixed values of the seekable format: a skippable frame of (compressed, decompressed) sizes and a footer, all little-endian.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "record_id string, bundle string, frame int, at long, length long"


class BundleWriter:
    """Appends frames to one file; close() adds the seek table."""

    def __init__(self, path: str):
        where, self.path = fs.FileSystem.from_uri(path)
        where.create_dir(os.path.dirname(self.path), recursive=True)
        self.file, self.sizes, self.pending, self.written = where.open_output_stream(self.path, compression=None), [], bytearray(), 0
        self.codec = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within the decompressed frame)"""
        place = len(self.sizes), len(self.pending)
        self.pending += record
        if len(self.pending) >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.codec.compress(bytes(self.pending))
            self.file.write(packed)
            self.sizes.append((len(packed), len(self.pending)))
            self.written += len(packed)
            self.pending.clear()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str):
        where, inner = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(inner)
        end = self.file.size()
        self.file.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path} has no plain seek table")
        self.file.seek(end - 9 - 8 * frames)
        self.sizes = list(struct.iter_unpack("<II", self.file.read(8 * frames)))
        self.starts, at = [], 0
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed

    def frame(self, number: int) -> bytes:
        packed, size = self.sizes[number]
        self.file.seek(self.starts[number])
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)

    def close(self) -> None:
        self.file.close()


def record_id(key: str | None, url: str | None, digest: str) -> str:
    """Depends on nothing but the record, so that a revisit can name its response and a task that runs again names its own alike."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, repr((key, url, digest)))}>"


def _header(name: str, value: str | None) -> str:
    """A header line; control characters are percent-encoded. Nothing for null."""
    return "" if value is None else f"{name}: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value) + "\r\n"


def record(key: str | None, url: str | None, payload: bytes, digest: str, length: int, refers: tuple[str | None, str | None] | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = "WARC/1.1\r\n" + _header("WARC-Type", "response" if refers is None else "revisit") + _header("WARC-Record-ID", record_id(key, url, digest)) + _header("WARC-Date", date)
    head += _header("WARC-Target-URI", url) + _header("WARC-Payload-Digest", f"sha256:{digest}") + _header("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        head += _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += _header("WARC-Refers-To", record_id(*refers, digest)) + _header("X-Refers-To-Key", refers[0])
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record, names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}, payload


def write_bundles(rows: DataFrame, *, key: str, url: str, payload: Column, least: int = 100, date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> DataFrame:
    """Writes a WARC record for each row into bundles below path (default: the shared folder) and returns their index.

    payload: the bytes, null counts as empty. Of rows with equal payloads of at least `least` bytes the one with the smallest key (null
    last) is a response and the others are revisits of it, by the identifier that it has under its smallest url (null first); further rows
    of that same key and payload are responses too, whatever their urls, as a page does not revisit itself. The other rows are all
    responses. Equal payloads are found by SHA-256 with an aggregate that combines before the shuffle; digests that occur twice are
    written and joined back, the most frequent ones by a broadcast, so that a payload of a third of all rows is spread over many tasks.
    Each task writes its own bundles under names that no other attempt uses and returns their index rows, so an attempt that is lost
    leaves a file that the index does not name; `manifest` lists those that it names, for whoever reads the folder without the index.
    Records are grouped into frames of about 256 KB that decompress on their own; the footer of a bundle holds the seek table.

    An empty table writes nothing. Rows that repeat key, url and payload are stored as often as they come, under one identifier. Other
    columns are dropped, so clashing names do no harm. Index: key, record_id, bundle, frame, at (offset in the decompressed frame), length.
    """
    spark = rows.sparkSession
    ship(rows.sparkSession)
    base = path or shared_dir(spark, "warc")
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    each = rows.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    each = each.withColumn("digest", F.sha2("body", 256)).withColumn("length", F.octet_length("body").cast("long"))
    order = F.struct(F.col("key").isNull().alias("late"), F.col("key").alias("key"), F.col("url").alias("url"))
    twice = each.where(F.col("length") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select("digest", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"), "n"), "warc-copies")
    limit = max(1000, (twice.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot, others = F.broadcast(twice.where(F.col("n") > limit)), twice.where(F.col("n") <= limit)  # at most HOT_KEYS are hot
    joined = each.join(hot, "digest").unionByName(each.join(F.broadcast(twice.where(F.col("n") > limit).select("digest")), "digest", "left_anti").join(others, "digest", "left"))
    revisits = F.col("n").isNotNull() & ~F.col("first_key").eqNullSafe(F.col("key")) & (F.col("length") >= least)
    joined = joined.select(
        "key", F.col("key").cast("string").alias("name"), "url", "digest", "length", F.when(~revisits, F.col("body")).alias("body"),
        revisits.alias("revisits"), F.col("first_key").cast("string").alias("first_key"), "first_url",
    )
    key_type = dict(rows.dtypes)[key]

    def write(batches):
        bundle, name = None, ""
        for batch in batches:
            places = []
            columns = [batch.column(c) for c in ("name", "url", "body", "digest", "length", "revisits", "first_key", "first_url")]
            for i in range(batch.num_rows):
                own, uri, content, digest, length, revisit, first_key, first_url = (c[i].as_py() for c in columns)
                if bundle is None:
                    name = f"{base}/bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(name)
                raw = record(own, uri, content or b"", digest, length, (first_key, first_url) if revisit else None, date)
                frame, at = bundle.add(raw)
                places.append((record_id(own, uri, digest), name, frame, at, len(raw)))
                if bundle.written >= BUNDLE_BYTES and not bundle.pending:
                    bundle.close()
                    bundle = None
            if places:
                types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], ["key", "record_id", "bundle", "frame", "at", "length"])
        if bundle is not None:
            bundle.close()

    return written(joined.mapInArrow(write, f"key {key_type}, {INDEX}"), "warc-index").withColumnRenamed("key", key)


def manifest(index: DataFrame, path: str) -> None:
    """Writes the names of the bundles that an index names to a text folder: whatever else lies beside them is of a lost attempt."""
    index.select("bundle").distinct().write.mode("overwrite").text(path)


def read_records(index: DataFrame, *, key: str) -> DataFrame:
    """Each record that the index names, read back from its bundle by frame and offset.

    A task gets whole frames, opens each bundle once, finds the frame by the seek table and cuts its records. A record that does not start
    with the identifier of its index row, or does not end where its length says, raises an error. An empty index gives an empty result.
    Result: key, record_id, warc_type, target_uri, payload_digest (bare, as the header has it), payload_length (as the HTTP header has
    it), payload (empty for a revisit), refers_to (a record identifier), refers_to_key.
    """
    ship(index.sparkSession)
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "length", "record_id", F.col(key).alias("key")))).alias("records"))
    key_type = dict(index.dtypes)[key]
    columns = ["key", "record_id", "warc_type", "target_uri", "payload_digest", "payload_length", "payload", "refers_to", "refers_to_key"]

    def read(batches):
        bundles: OrderedDict[str, BundleReader] = OrderedDict()
        for batch in batches:
            key_of = batch.schema.field("records").type.value_type.field("key").type
            types = (key_of, pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
            for i in range(batch.num_rows):
                name, frame = batch.column("bundle")[i].as_py(), batch.column("frame")[i].as_py()
                if name not in bundles:
                    bundles[name] = BundleReader(name)
                    if len(bundles) > 16:
                        bundles.popitem(last=False)[1].close()
                data, out = bundles[name].frame(frame), []
                for r in batch.column("records")[i].as_py():
                    warc, http, payload = parsed(data[r["at"] : r["at"] + r["length"]])
                    if warc["warc-record-id"] != r["record_id"]:
                        raise ValueError(f"{name} has another record where {r['record_id']} should be")
                    digest = warc["warc-payload-digest"].removeprefix("sha256:")
                    out.append((r["key"], r["record_id"], warc["warc-type"], warc.get("warc-target-uri"), digest, int(http["content-length"]), payload, warc.get("warc-refers-to"), warc.get("x-refers-to-key")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)
        for reader in bundles.values():
            reader.close()

    schema = f"key {key_type}, record_id string, warc_type string, target_uri string, payload_digest string, payload_length long, payload binary, refers_to string, refers_to_key string"
    return frames.mapInArrow(read, schema).withColumnRenamed("key", key)


def read_record(spark: SparkSession, index: DataFrame, identifier: str, *, key: str) -> DataFrame:
    """The record of one identifier; a single frame is decompressed."""
    return read_records(index.where(F.col("record_id") == identifier), key=key)
