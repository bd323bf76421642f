"""Compaction: which runs to merge, and what their merge keeps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAX_NANOS, Options
from .kv import resolve_latest
from .logs import latest_logs
from .retention import retain_size, retain_time


@dataclass(frozen=True)
class Run:
    """One sorted table of the store, as the manifest knows it."""

    id: int
    kind: str
    level: int
    path: str
    records: int
    bytes: int
    min_key: str | None = None
    max_key: str | None = None
    min_ts: int | None = None
    max_ts: int | None = None
    labels: dict[str, int] | None = None
    label_values: dict[str, list[str]] | None = None
    #: The first key of each file, and whether labels of many values have a Bloom filter beside the run.
    first_keys: list | None = None
    bloom: bool = False
    format: int = 1

    def low(self):
        return self.min_key if self.kind == "kv" else self.min_ts

    def high(self):
        return self.max_key if self.kind == "kv" else self.max_ts


def level_capacity(level: int, options: Options) -> int:
    return min(MAX_NANOS, options.level_base_bytes * options.level_multiplier ** max(0, level - 1))


def next_level(runs: list[Run], options: Options) -> int | None:
    """The level that is due: 0 at the threshold of runs, else the first that holds more than its capacity."""
    if options.compaction_threshold and sum(r.level == 0 for r in runs) >= options.compaction_threshold:
        return 0
    for level in range(1, options.max_levels - 1):
        if sum(r.bytes for r in runs if r.level == level) > level_capacity(level, options):
            return level
    return None


def overlapping(runs: list[Run], low, high) -> list[Run]:
    return [r for r in runs if r.low() is not None and r.low() <= high and r.high() >= low]


def select_runs(runs: list[Run], level: int) -> list[Run]:
    """Inputs of a level: all of level 0, else its first run; with the next level's runs that overlap them."""
    own = [r for r in runs if r.level == level]
    own = own if level == 0 else own[:1]
    if not own:
        return []
    low, high = min(r.low() for r in own), max(r.high() for r in own)
    return own + overlapping([r for r in runs if r.level == level + 1], low, high)


#: Bytes that one task of a merge takes at most, whatever the number of workers is.
TASK_LIMIT = 1 << 30


def task_count(total_bytes: int, options: Options, cores: int = 4) -> int:
    """Tasks of a merge: one for each compaction_task_bytes, as many as there are workers at most, and never so few that
    one has more than TASK_LIMIT."""
    workers = options.compaction_workers or cores
    return max(1, min(workers, math.ceil(total_bytes / options.compaction_task_bytes)), math.ceil(total_bytes / TASK_LIMIT))


def split_points(first_keys: list, tasks: int) -> list[tuple]:
    """Half-open key ranges from sorted first keys of files, one a task at most; None is an open bound."""
    keys = sorted(set(first_keys))
    if tasks < 2 or len(keys) < 2:
        return [(None, None)]
    tasks = min(tasks, len(keys))
    cuts = sorted({keys[t * len(keys) // tasks] for t in range(1, tasks)})
    edges = [None, *cuts, None]
    return list(zip(edges, edges[1:]))


def in_ranges(rows: DataFrame, column: str, ranges: list[tuple]) -> DataFrame:
    """Deals rows to one task for each range, in the order of the ranges: no sampling pass, and nothing is read twice."""
    cuts = [low for low, _ in ranges[1:]]
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)
    return rows.repartitionById(len(ranges), number)


def merge_kv(versions: DataFrame, *, bottom: bool) -> DataFrame:
    """The newest version of each key; tombstones go at the bottom, above it they still hide older runs."""
    merged = resolve_latest(versions)
    return merged.where("not deleted") if bottom else merged


def merge_logs(logs: DataFrame, *, bottom: bool, now_nanos: int, options: Options, other_bytes: int = 0) -> DataFrame:
    """One entry for each key; at the bottom, what retention by time and then by size leaves."""
    merged = latest_logs(logs)
    if not bottom:
        return merged
    kept = retain_time(merged, now_nanos, options.retention_nanos)
    return retain_size(kept, options.max_size_bytes, other_bytes)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records in, records out, and how many were dropped."""
    counted = before.agg(F.count("*").alias("input_records"), F.lit(0).alias("output_records")).unionByName(after.agg(F.lit(0).alias("input_records"), F.count("*").alias("output_records")))
    return counted.agg(F.sum("input_records").alias("input_records"), F.sum("output_records").alias("output_records")).withColumn("dropped_records", F.col("input_records") - F.col("output_records"))
