"""What compaction drops by age and by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LOG_KEY_BYTES, LOG_ORDER, LOG_VALUE_BYTES, TABLE_RECORD_BYTES


def log_bytes() -> Column:
    """The accounted size of a log entry, uncompressed."""
    return (F.octet_length("label_key") + F.octet_length("message") + (TABLE_RECORD_BYTES + LOG_KEY_BYTES + LOG_VALUE_BYTES)).cast("long")


def kv_bytes() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + TABLE_RECORD_BYTES).cast("long")


def retain_time(logs: DataFrame, now_nanos: int, retention_nanos: int) -> DataFrame:
    """Drops entries older than the retention; an entry exactly as old stays, and 0 keeps all."""
    return logs.where(F.col("ts_nanos") >= now_nanos - retention_nanos) if retention_nanos else logs


#: Bucket widths that narrow a cutoff down: an hour, a second, a microsecond, a nanosecond.
_WIDTHS = (3_600_000_000_000, 1_000_000_000, 1_000, 1)


def retain_size(logs: DataFrame, max_bytes: int, other_bytes: int = 0) -> DataFrame:
    """Drops the oldest entries until what is left, with other_bytes, holds max_bytes at most; 0 keeps all.

    The cutoff is found by sums for each time bucket, ever narrower inside the bucket that it falls in, and only
    entries of the very nanosecond of the cutoff are ranked by a window. No task sees all entries.
    """
    if not max_bytes:
        return logs
    room = max_bytes - other_bytes
    low, rows = None, logs
    for width in _WIDTHS:
        bucket = F.expr(f"ts_nanos div {width} - CASE WHEN ts_nanos % {width} < 0 THEN 1 ELSE 0 END")
        sums = rows.groupBy(bucket.alias("bucket")).agg(F.sum(log_bytes()).alias("size"))
        newer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("total", F.sum("size").over(newer)).where(F.col("total") > room).orderBy(F.desc("bucket")).select("bucket", "size", "total").first()
        if over is None:
            return logs if low is None else logs.where(F.col("ts_nanos") >= low)
        low = over.bucket * width
        room -= over.total - over["size"]
        rows = rows.where((F.col("ts_nanos") >= low) & (F.col("ts_nanos") < low + width))
    at = logs.where(F.col("ts_nanos") == low)
    newest = Window.partitionBy("ts_nanos").orderBy(*[F.desc(c) for c in LOG_ORDER]).rowsBetween(Window.unboundedPreceding, 0)
    kept = at.withColumn("__size", F.sum(log_bytes()).over(newest)).where(F.col("__size") <= room).drop("__size")
    return logs.where(F.col("ts_nanos") > low).unionByName(kept)
