"""Streaming ingest: each micro-batch is checked, numbered and published as one change."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import InvalidEntry
from ..sources.json_logs import entries_from_lines
from ..sources.store import Store


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the lines of JSON files that arrive in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)


def ingest(lines: DataFrame, store: Store, checkpoint: str, *, on_error: str = "refuse", now=time.time_ns) -> StreamingQuery:
    """Writes a stream of JSON entries into a store, all that has arrived, each batch exactly once.

    A batch's rows and its mark, the query's id and the batch's number, are published in one generation; a batch that comes
    again after a failure is known by it and passed over. The id belongs to the checkpoint, so another stream, or the
    same folder read with a new checkpoint, counts for itself. on_error: refuse stops at a batch with a bad entry, skip
    leaves bad ones out.
    """

    def publish(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if number <= store.load().streams.get(stream, -1):
            return
        rows = entries_from_lines(batch, now()).persist()
        try:
            if on_error == "refuse" and not rows.where("error is not null").isEmpty():
                raise InvalidEntry(rows.where("error is not null").first().error)
            store.append_logs(rows.where("error is null").drop("error"), stream, number)
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_rates(logs: DataFrame, label: str, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Entries of each label value in each time window, with a watermark, for a stream or a table of logs."""
    ts = F.timestamp_micros((F.col("ts_nanos") / 1000).cast("long"))
    rows = logs.select(ts.alias("ts"), F.col("labels")[label].alias("value"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", window).alias("w"), "value").agg(F.count("*").alias("entries")).select("w.start", "w.end", "value", "entries")
