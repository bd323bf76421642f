"""A change log of (segment_id, record_no, op, key, value) rows, replayed by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_records(changes: DataFrame) -> DataFrame:
    """Rows that can be applied: a known operation and a key; a put has a value."""
    return changes.where(F.col("op").isin("put", "delete") & (F.col("key") != "") & ((F.col("op") == "delete") | F.col("value").isNotNull()))


def bad_records(changes: DataFrame) -> DataFrame:
    """One row: how many rows a replay skips."""
    return changes.agg((F.count("*") - F.count_if(F.col("op").isin("put", "delete") & (F.col("key") != "") & ((F.col("op") == "delete") | F.col("value").isNotNull()))).alias("bad_records"))


def replay(changes: DataFrame) -> DataFrame:
    """The newest valid record of each key as (key, value, deleted); later segments and later records win."""
    place = F.struct("segment_id", "record_no")
    return valid_records(changes).groupBy("key").agg(F.max_by(F.struct(F.when(F.col("op") == "put", F.col("value")).alias("value"), (F.col("op") == "delete").alias("deleted")), place).alias("x")).select("key", "x.value", "x.deleted")


def prune_through(changes: DataFrame, segment_id: int) -> DataFrame:
    """What stays once all segments up to one are in runs."""
    return changes.where(F.col("segment_id") > segment_id)
