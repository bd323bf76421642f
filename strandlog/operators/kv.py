"""Versioned keys: last write wins, tombstones hide, ranges are half open."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import InvalidRange


def resolve_latest(versions: DataFrame) -> DataFrame:
    """Each key's newest version, tombstones too; combines on the map side, and filters on the key pass below it."""
    return versions.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("x"), F.max("version").alias("version")).select("key", "x.value", "x.deleted", "version")


def live(versions: DataFrame) -> DataFrame:
    return resolve_latest(versions).where("not deleted").select("key", "value")


def get(versions: DataFrame, key: str) -> DataFrame:
    """No row or one: the key's live value."""
    return live(versions.where(F.col("key") == key))


def multi_get(versions: DataFrame, keys: Iterable[str] | DataFrame) -> DataFrame:
    """Live values of many keys; a table of keys joins on the key before versions are resolved."""
    if isinstance(keys, DataFrame):
        return live(versions.join(keys.select("key").distinct(), "key", "left_semi"))
    return live(versions.where(F.col("key").isin(sorted(set(keys)))))


def key_range(start: str = "", end: str = "", column: str = "key", strict: bool = True) -> Column:
    """start <= key < end by bytes; an empty bound is open."""
    if strict and start and end and start >= end:
        raise InvalidRange("the start must be before the end")
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= start)
    if end:
        out = out & (F.col(column) < end)
    return out


def scan(versions: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Live keys of a half-open range, by key."""
    return live(versions.where(key_range(start, end))).orderBy("key")


def scan_raw(versions: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Newest versions of a range with their tombstones, by key; an inverted range is empty."""
    if start and end and start >= end:
        return resolve_latest(versions.where(F.lit(False)))
    return resolve_latest(versions.where(key_range(start, end))).orderBy("key")


def lower_bound(versions: DataFrame, key: str) -> DataFrame:
    """The first key at or after the given one, tombstones counted as present."""
    return resolve_latest(versions.where(F.col("key") >= key)).orderBy("key").limit(1)


def first_last(versions: DataFrame) -> DataFrame:
    """One row: the smallest and the largest live key with their values."""
    return live(versions).agg(F.min("key").alias("first_key"), F.min_by("value", "key").alias("first_value"), F.max("key").alias("last_key"), F.max_by("value", "key").alias("last_value"))


def batch_versions(operations: DataFrame, base_version: int) -> DataFrame:
    """An ordered batch (op_index, op, key, value) as versions after base_version; a later operation on a key wins.

    An unknown operation or an empty key is an error for the whole batch.
    """
    bad = ~F.col("op").isin("put", "delete") | F.col("key").isNull() | (F.col("key") == "") | ((F.col("op") == "put") & F.col("value").isNull())
    key = F.when(bad, F.raise_error("the batch holds an invalid operation").cast("string")).otherwise(F.col("key"))
    return operations.select(key.alias("key"), F.when(F.col("op") == "put", F.col("value")).alias("value"), (F.col("op") == "delete").alias("deleted"), (F.col("op_index") + F.lit(base_version + 1)).cast("long").alias("version"))


def insert_absent(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (key, value) whose key isn't live."""
    return new.join(live(versions).select("key"), "key", "left_anti")
