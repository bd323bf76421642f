"""Seekable Zstandard bundles of WARC records."""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ship

#: Fixed values of the seekable Zstandard format: a skippable frame with this magic holds the table, its footer ends with the other.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
BUNDLE = "bundle_id string, bundle binary, n_records int, records array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
PLACE = "frame int, offset long, length long"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer frame: each frame's (compressed, decompressed) size, then their number, no checksums, the magic."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle ends without a seek table")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(bundle) - 9 - n * width, 0, []
    for i in range(n):
        size, full = struct.unpack_from("<II", bundle, at + i * width)
        out.append((start, size, full))
        start += size
    return out


def read_frame(bundle: bytes, number: int) -> bytes:
    start, size, full = frames(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=full)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by the index: decompresses its frame only."""
    return read_frame(bundle, frame)[offset : offset + length]


def header_value(value: str) -> str:
    """A header's value on one line: control characters and % are percent-coded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, url: str | None, digest: str, payload: bytes, payload_bytes: int, refers_to: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, payload, offset, length) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size + 4
        yield head, data[end + 4 : end + 4 + size], at, stop - at
        at = stop


def record_id(key: int | None) -> str:
    return "urn:page:" + ("null" if key is None else str(key))


class Bundler:
    """Collects records into frames of about frame_bytes and frames into bundles of about bundle_bytes."""

    def __init__(self, frame_bytes: int, bundle_bytes: int, level: int = 3):
        self.frame_bytes, self.bundle_bytes, self.zstd = frame_bytes, bundle_bytes, zstandard.ZstdCompressor(level=level)
        self._start()

    def _start(self):
        self.pending, self.held, self.parts, self.sizes, self.size, self.index = [], 0, [], [], 0, []

    def _frame(self):
        if self.pending:
            raw = b"".join(self.pending)
            self.parts.append(self.zstd.compress(raw))
            self.sizes.append((len(self.parts[-1]), len(raw)))
            self.size, self.pending, self.held = self.size + len(self.parts[-1]), [], 0

    def add(self, record_id: str, raw: bytes):
        if self.held and self.held + len(raw) > self.frame_bytes:
            self._frame()
        self.index.append({"record_id": record_id, "frame": len(self.parts), "offset": self.held, "length": len(raw)})
        self.pending.append(raw)
        self.held += len(raw)
        if self.size + self.held >= self.bundle_bytes:
            yield self.finish()

    def finish(self) -> tuple[str, bytes, int, list[dict]]:
        """The bundle's name (its SHA-1), its bytes, the number of its records and where each of them stands."""
        self._frame()
        data = b"".join(self.parts) + seek_table(self.sizes)
        out = hashlib.sha1(data).hexdigest(), data, len(self.index), self.index
        self._start()
        return out


_PLACES = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def _pack(frame_bytes: int, bundle_bytes: int):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int32(), _PLACES))], names=["bundle_id", "bundle", "n_records", "records"])

    def run(batches):
        bundler, made = Bundler(frame_bytes, bundle_bytes), []
        for batch in batches:
            for key, url, digest, size, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if refers is None else "revisit"
                made += bundler.add(record_id(key), record(kind, record_id(key), url, digest, payload, size, None if refers is None else record_id(refers)))
                if made:
                    yield batch_of(made)
                    made = []
        if bundler.index:
            yield batch_of([bundler.finish()])

    return run


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20) -> DataFrame:
    """Writes one WARC record a row into seekable bundles in the shared folder: (bundle_id, bundle, n_records, records).

    records maps each record's id to its frame, and to its offset and length in that frame; it is written with the bundle,
    and being a column of its own it is read without the bundles (see archive_index).

    Records with equal payloads of least_bytes or more: the one with the largest id is the response, the others
    revisit it. Winners are maxima per digest by partial aggregation; only digests that repeat join back, and AQE can
    split a hot one. A bundle is a whole .warc.zst file as one row of a Parquet table, so Spark's committer takes
    care of lost executors and doubled attempts; export_archive gives the files.

    A null payload is empty, a null url has no Target-URI. Rows that repeat an id are each a record; those with the
    winning id are all responses. Null ids win over nothing: they count as below every other id, and records that
    all have null ids are responses. Other columns are ignored; an empty table gives no bundle.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("key", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    repeats = rows.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.max("key").alias("winner"), F.count("*").alias("n")).where("n > 1").select("d", "s", "winner")
    joined = rows.join(repeats, (rows.digest == repeats.d) & (rows["size"] == repeats.s), "left")
    refers = F.when(F.col("winner").isNotNull() & ~F.col("key").eqNullSafe(F.col("winner")), F.col("winner"))
    body = F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b""))
    records = joined.select("key", "url", "digest", "size", body.alias("payload"), refers.alias("refers"))
    return Scratch(pages.sparkSession, "warc").table("bundles", records.mapInArrow(_pack(frame_bytes, bundle_bytes), BUNDLE))


def _unpack(batches):
    names = ["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "frame", "offset", "length"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    key = lambda x: None if x is None or x.endswith(":null>") else int(x[len("<urn:page:") : -1])
    for batch in batches:
        for bundle in batch.column(0):
            data = bundle.as_py()
            for number in range(len(frames(data))):
                rows = []
                for head, payload, offset, length in parse_records(read_frame(data, number)):
                    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    size = int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (size != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't fit its digest")
                    rows.append((head["WARC-Record-ID"][1:-1], key(head["WARC-Record-ID"]), head["WARC-Type"], size, digest, key(head.get("WARC-Refers-To")), number, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archive(bundles: DataFrame) -> DataFrame:
    """Reads bundles back, frame by frame through the seek table, and checks every response's digest.

    One row a record, with the place that lets read_record fetch it alone: frame, and offset and length in that frame.
    """
    ship(bundles.sparkSession)
    return bundles.select("bundle").mapInArrow(_unpack, "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, " + PLACE)


def archive_index(bundles: DataFrame) -> DataFrame:
    """The stored map from record ids to places: (record_id, bundle_id, frame, offset, length). Reads no bundle."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")


def _fetch(batches):
    for batch in batches:
        found, held = [], (None, None)
        for name, data, frame, offset, length in zip(*(batch.column(c) for c in ("bundle_id", "bundle", "frame", "offset", "length"))):
            if held[0] != (now := (name.as_py(), frame.as_py())):
                held = now, read_frame(data.as_py(), frame.as_py())
            found.append(held[1][offset.as_py() : offset.as_py() + length.as_py()])
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(found, pa.binary())], names=["record_id", "record"])


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted (record_id), by the stored index: (record_id, record). Only frames that hold one are decompressed.

    Ids that no bundle has give no row; records that share an id all come, and repeated or null wanted ids count once or not at all.
    """
    ship(bundles.sparkSession)
    places = archive_index(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    held = bundles.select("bundle_id", "bundle").dropDuplicates(["bundle_id"])
    return places.join(held, "bundle_id").sortWithinPartitions("bundle_id", "frame").select("record_id", "bundle_id", "bundle", "frame", "offset", "length").mapInArrow(_fetch, "record_id string, record binary")


def export_archive(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <bundle_id>.warc.zst into a folder that executors reach, a path or a URI (file, hdfs, s3, gs): (file, n_records).

    The name follows from the bytes and the file is moved into place, so a task that runs twice changes nothing.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = [f"{name}.warc.zst" for name in batch.column(0).to_pylist()]
            for name, bundle in zip(names, batch.column(1)):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(bundle.as_py())
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(2)], names=["file", "n_records"])

    ship(bundles.sparkSession)
    return bundles.select("bundle_id", "bundle", "n_records").mapInArrow(run, "file string, n_records int")
