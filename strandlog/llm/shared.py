"""Helpers that every training-data operator uses: scratch tables in the shared folder and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/strandlog-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that they needn't have it installed."""
    import atexit
    import os
    import shutil
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder_of_zip = os.path.realpath(tempfile.mkdtemp(prefix="strandlog-"))
    atexit.register(shutil.rmtree, folder_of_zip, True)
    path = os.path.join(folder_of_zip, "strandlog_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    own = os.path.join(folder, name)
                    out.write(own, os.path.join(os.path.basename(package), os.path.relpath(own, package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


#: Spark's setting that deletes a query's shuffle files as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}
        ship(spark)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as zstd Parquet and reads it back with the schema that was written; its shuffle files go with the write's end."""
        path = scratch_path(self.spark, f"{self.tag}-{name}")
        held = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if held is None else self.spark.conf.set(_CLEANUP, held)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables of these names, which nothing reads any more."""
        for name in names:
            if name in self.paths:
                _delete(self.spark, self.paths.pop(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*[n for n in self.paths if n not in names])


#: Ids that are sent to all executors instead of shuffling the texts that are looked up in them (some 40 MB).
_TOLD = 1 << 20


def told(ids: DataFrame) -> DataFrame:
    """One column of ids, for a semi or anti join with texts: up to 2^20 go to the executors, so that no text is moved; more are joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= _TOLD else ids


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; results that still read them become unreadable."""
    _delete(spark, f"{shared_root(spark)}/strandlog-{spark.sparkContext.applicationId}")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them (null: empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20):
    """Cuts a batch into runs of rows whose texts hold about most_bytes, one row at least: bounded work memory."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64), a part at a time to stay in the cache."""
    h = h.copy()
    for at in range(0, len(h), 1 << 16):
        x = h[at : at + (1 << 16)]
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return h


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = 0x9E3779B97F4A7C15
_SHORT = 4


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of raw (and its end) as one little-endian number, zeros past the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def _pieces(at8: np.ndarray, start: np.ndarray, end: np.ndarray, first: int):
    """All eight-byte pieces of long runs from their piece `first` on: (the runs' first rows, piece values, piece numbers)."""
    count = -(-(end - start) // 8) - first
    lead = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(lead, count) + first
    at = np.repeat(start, count) + 8 * number
    return lead, at8[at] & _MASKS[np.minimum(np.repeat(end, count) - at, 8)], number


def _keyed(value: np.ndarray, number, seed: int) -> np.ndarray:
    if isinstance(number, int):
        return mixed(value ^ np.uint64((number + seed + 1) * _STEP % (1 << 64)))
    return mixed(value ^ (number.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(_STEP))


def span_hashes(at8: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end) of what `eights` gave, the same wherever a run stands.

    A run is cut into pieces of eight bytes; each piece goes through a full mixer keyed by its number, and the sum of
    these with the length through another. Runs of up to eight bytes collide never but for the last 64-bit step, longer
    ones by chance alone: there is no base whose powers could cancel, as in polynomials modulo 2**64.
    Among n different runs of one seed a pair collides with a chance of about n**2 / 2**65.
    """
    size = end - start
    out = np.asarray(size, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    live = np.flatnonzero(size > 0)
    for k in range(_SHORT):
        if not len(live):
            break
        left = size[live] - 8 * k
        out[live] += _keyed(at8[start[live] + 8 * k] & _MASKS[np.minimum(left, 8)], k, seed)
        live = live[left > 8]
    if len(live):
        lead, value, number = _pieces(at8, start[live], end[live], _SHORT)
        out[live] += np.add.reduceat(_keyed(value, number, seed), lead)
    return mixed(out)


def same_spans(at8: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the size bytes at a and at b (of other, if given) are equal, run by run, by comparing the bytes."""
    there = at8 if other is None else other
    out = np.ones(len(a), bool)
    live = np.flatnonzero((size > 0) & (a != b) if other is None else size > 0)
    for k in range(_SHORT):
        if not len(live):
            return out
        left = size[live] - 8 * k
        mask = _MASKS[np.minimum(left, 8)]
        out[live] = (at8[a[live] + 8 * k] & mask) == (there[b[live] + 8 * k] & mask)
        live = live[(left > 8) & out[live]]
    if len(live):
        lead, x, _ = _pieces(at8, a[live], a[live] + size[live], _SHORT)
        _, y, _ = _pieces(there, b[live], b[live] + size[live], _SHORT)
        out[live] = np.logical_and.reduceat(x == y, lead)
    return out


_PLACES = np.array([(_STEP * (2 * k + 1) ** 3) % (1 << 64) | 1 for k in range(64)], np.uint64)


def sequence_hashes(values: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of the runs values[start : start + size] of up to 64 mixed 64-bit values, by place and length."""
    size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
    out = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(int(size.max(initial=0))):
        if (size > k).all():
            out += values[start + k] * _PLACES[k]
        else:
            live = np.flatnonzero(size > k)
            out[live] += values[start[live] + k] * _PLACES[k]
    return mixed(out)
