"""A store of logs and keys: sorted Parquet runs, and a manifest that is published in generations."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bloom import BloomFilter, build_bloom
from ..functions.labels import check_labels, escaped, labels_valid, python_label_key
from ..functions.times import format_rfc3339
from ..model import Conflict, CorruptStore, InvalidEntry, KV_SCHEMA, LOG_ORDER, LOG_SCHEMA, Options
from ..operators import compaction, kv, logs
from ..operators.compaction import Run
from ..operators.retention import kv_bytes, retain_size
from ..plans.querylang import LogQuery, parse_query
from .files import Files

FORMAT = 1
#: Labels of more different values than this in a run are not listed in the manifest, but stand in a Bloom filter beside the run.
LISTED_VALUES = 1000
#: Bytes that a task of a checkpoint or an upgrade writes, about.
RUN_TASK_BYTES = 64 << 20
#: After so long a manifest that can't be read is taken as left by a writer that died.
TORN_SECONDS = 600


@dataclass
class Manifest:
    """One generation: its runs, changes not yet in a run, and the counters that writes go on from."""

    generation: int
    runs: list[Run]
    changes: list[dict]
    next_id: int = 1
    last_sequence: int = 0
    last_version: int = 0
    format: int = FORMAT
    #: The last batch that each stream has published, and how often what was done.
    streams: dict[str, int] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    def counted(self, **more: int) -> dict[str, int]:
        return {k: self.counters.get(k, 0) + more.get(k, 0) for k in {**self.counters, **more}}

    def text(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Manifest:
        try:
            raw = json.loads(text)
            runs = [Run(**r) for r in raw.pop("runs")]
            out = cls(runs=runs, **raw)
        except (TypeError, KeyError, ValueError) as e:
            raise CorruptStore(f"the manifest can't be read: {e}") from e
        ids = [r.id for r in runs]
        if out.format > FORMAT or len(ids) != len(set(ids)) or any(r.level < 0 or "/" in r.path or not r.path for r in runs):
            raise CorruptStore("the manifest holds an unknown format, a run twice or a broken path")
        return out


class Store:
    """Opens or creates a store in a folder. One writer publishes at a time; a second one gets a Conflict and may retry."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options, self.files = spark, path.rstrip("/"), options or Options(), Files(spark)
        self.last_error: str | None = None
        if not self.files.exists(f"{self.path}/CURRENT"):
            self.files.make(f"{self.path}/data")
            self._publish(Manifest(0, [], []), first=True)
        self.manifest = self.load()
        self.reads = {"read_operations": 0, "runs_read": 0, "runs_skipped": 0}
        self._blooms: dict[str, BloomFilter] = {}

    # manifest

    def load(self) -> Manifest:
        """The newest generation. Its manifest's creation is what publishes it; CURRENT follows, and is put right if its writer died before that."""
        name = self.files.read(f"{self.path}/CURRENT").strip()
        if not name.startswith("MANIFEST-") or not self.files.exists(f"{self.path}/{name}"):
            raise CorruptStore(f"CURRENT names {name!r}, which isn't there")
        for later in reversed([n for n in self._manifests() if n > name]):
            try:
                found = Manifest.of(self.files.read(f"{self.path}/{later}"))
            except CorruptStore:  # of a writer that died, or still is at it
                if self.files.age_seconds(f"{self.path}/{later}", time.time_ns() // 1_000_000) > TORN_SECONDS:
                    self.files.delete(f"{self.path}/{later}")
                continue
            self.files.replace(f"{self.path}/CURRENT", later)
            return found
        return Manifest.of(self.files.read(f"{self.path}/{name}"))

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names(self.path) if re.fullmatch(r"MANIFEST-\d{20}", n)]

    def _publish(self, manifest: Manifest, first: bool = False) -> None:
        new = manifest if first else replace(manifest, generation=manifest.generation + 1)
        name = f"MANIFEST-{new.generation:020d}"
        if not self.files.create(f"{self.path}/{name}", new.text()) and not first:
            raise Conflict(f"generation {new.generation} is there already")
        self.manifest = new
        try:
            self.files.replace(f"{self.path}/CURRENT", name)
            for n in [n for n in self._manifests() if n <= name][: -self.options.keep_generations]:
                self.files.delete(f"{self.path}/{n}")
        except Exception as e:  # noqa: BLE001  the generation is published; whoever opens the store next puts CURRENT right
            if first:
                raise
            self.last_error = f"CURRENT is behind: {str(e).splitlines()[0] if str(e) else type(e).__name__}"[:500]

    def _data(self, path: str) -> str:
        return f"{self.path}/data/{path}"

    def _delete_data(self, *paths: str) -> None:
        for path in paths:
            self.files.delete(self._data(path))

    @contextmanager
    def _cleaning(self, *made: str):
        """What fails inside leaves none of the made data behind, and is remembered as the last error."""
        written = list(made)
        try:
            yield written
        except Exception as e:
            self.last_error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
            self._delete_data(*written)
            raise

    def _add(self, df: DataFrame, kind: str, records: int | None, streams: dict[str, int] | None = None, **counters) -> None:
        """Appends a change: its rows first, then the generation that knows of them (and of the stream's batch that they are)."""
        path = f"change-{kind}-{uuid.uuid4().hex}"
        with self._cleaning(path):
            df.write.option("compression", self.options.compression).parquet(self._data(path))
            change = {"kind": kind, "path": path, "bytes": self.files.bytes(self._data(path)), "records": records or 0}
            self._publish(replace(self.manifest, changes=[*self.manifest.changes, change], streams={**self.manifest.streams, **(streams or {})}, counters=self.manifest.counted(write_operations=records or 0, write_batches=1), **counters))
        if self.options.auto_checkpoint and sum(c["bytes"] for c in self.manifest.changes) >= self.options.checkpoint_bytes:
            self.checkpoint()

    # writes

    def put(self, key: str, value: str) -> None:
        self.write_batch([("put", key, value)])

    def delete(self, key: str) -> None:
        """Writes a tombstone, whether the key is there or not."""
        self.write_batch([("delete", key, None)])

    def write_batch(self, operations: Iterable[tuple[str, str, str | None]] | DataFrame) -> None:
        """An ordered batch of (op, key, value), or a table that has op_index too; checked as a whole, then one change."""
        if not isinstance(operations, DataFrame):
            rows = [(i, *o) for i, o in enumerate(operations)]
            if not rows:
                return
            for _, op, key, value in rows:
                if op not in ("put", "delete") or not key or (op == "put") == (value is None):
                    raise InvalidEntry("the batch holds an invalid operation")
            operations = self.spark.createDataFrame(rows, "op_index long, op string, key string, value string")
        n, records = operations.agg(F.max("op_index"), F.count("*")).first()
        if n is None:
            return
        self._add(kv.batch_versions(operations, self.manifest.last_version), "kv", records, last_version=self.manifest.last_version + n + 1)

    def write_logs(self, entries: Iterable[tuple[int, dict[str, str], str, int]]) -> None:
        """Log entries (ts_nanos, labels, message, sequence); sequence 0 is given the next number, in the order of the list."""
        rows, high = [], self.manifest.last_sequence
        for ts, labels, message, sequence in entries:
            labels = check_labels(labels.items() if isinstance(labels, dict) else labels)
            if message is None or sequence < 0 or sequence >= 1 << 63:
                raise InvalidEntry("an entry needs a message and a sequence below 2**63")
            sequence = sequence or high + 1
            high = max(high, sequence)
            rows.append((ts, labels, python_label_key(labels), sequence, message))
        if rows:
            self._add_logs(self.spark.createDataFrame(rows, LOG_SCHEMA), high, len(rows))

    def append_logs(self, entries: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """A table of log entries (ts_nanos, labels, label_key, sequence, message), checked and numbered in the cluster.

        Its rows are read twice: once to check and count them, once to number and write them. A batch of a stream is
        published in one generation with its number; one that the store has already is passed over, and that is told.
        """
        if stream is not None and batch <= self.manifest.streams.get(stream, -1):
            return False
        invalid = F.col("message").isNull() | (F.col("sequence") < 0) | ~labels_valid(F.col("labels"))
        count, bad, high, fresh = entries.agg(F.count("*"), F.count_if(invalid), F.max("sequence"), F.count_if(F.col("sequence") == 0)).first()
        if bad:
            raise InvalidEntry("the batch holds an invalid entry")
        streams = {stream: batch} if stream is not None else {}
        if not count:
            if streams:
                self._publish(replace(self.manifest, streams={**self.manifest.streams, **streams}))
            return True
        rows, top = entries.select(*LOG_SCHEMA.names), max(high, self.manifest.last_sequence)
        if fresh:
            rows = logs.assign_sequences(rows, self.manifest.last_sequence, high)
        self._add_logs(rows, top + fresh, count, streams)
        return True

    def _add_logs(self, df: DataFrame, high: int, count: int, streams: dict[str, int] | None = None) -> None:
        version = self.manifest.last_version + 1
        promoted = [F.col("labels")[name].alias(f"label_{name}") for name in self.options.promoted_labels]
        self._add(df.select("*", F.lit(version).cast("long").alias("version"), *promoted), "log", count, streams, last_sequence=high, last_version=version)

    # reads

    def _read(self, kind: str, paths: list[str]) -> DataFrame:
        schema = KV_SCHEMA
        if kind == "log":
            own = [T.StructField("version", T.LongType()), *[T.StructField(f"label_{name}", T.StringType()) for name in self.options.promoted_labels]]
            schema = T.StructType([*LOG_SCHEMA.fields, *own])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._data(p) for p in paths])

    def _paths(self, kind: str, wanted=lambda run: True) -> list[str]:
        runs = [r for r in self.manifest.runs if r.kind == kind]
        some = [r.path for r in runs if wanted(r)]
        for name, n in (("read_operations", 1), ("runs_read", len(some)), ("runs_skipped", len(runs) - len(some))):
            self.reads[name] += n
        return some + [c["path"] for c in self.manifest.changes if c["kind"] == kind]

    def versions(self, start: str = "", end: str = "") -> DataFrame:
        """All versions in runs whose keys overlap a range, and in changes."""
        return self._read("kv", self._paths("kv", lambda r: (not end or r.min_key < end) and (not start or r.max_key >= start)))

    def get(self, key: str) -> str | None:
        """The live value; runs are skipped by their key range, row groups by Parquet's statistics and Bloom filters."""
        row = kv.get(self._read("kv", self._paths("kv", lambda r: r.min_key <= key <= r.max_key)), key).first()
        return None if row is None else row.value

    def scan(self, start: str = "", end: str = "") -> DataFrame:
        return kv.scan(self.versions(start, end), start, end)

    def iterate(self, start: str = "", end: str = "") -> Iterator[tuple[str, str | None, bool]]:
        """Newest versions of a key range in order, tombstones too, as (key, value, deleted); a partition at a time comes to the driver."""
        for row in kv.scan_raw(self.versions(start, end), start, end).toLocalIterator():
            yield row.key, row.value, row.deleted

    def may_hold(self, run: Run, labels: dict[str, str]) -> bool:
        """Whether a run can have entries with all of the labels: by its listed values, or its Bloom filter. Never a wrong no."""
        for name, value in labels.items():
            if value == "":
                continue  # matches entries without the label too
            if name not in (run.labels or {}):
                return False
            if name in (run.label_values or {}):
                if value not in run.label_values[name]:
                    return False
            elif run.bloom:
                if run.path not in self._blooms:
                    self._blooms[run.path] = BloomFilter.of(self.files.read(f"{self._data(run.path)}.bloom"))
                if not self._blooms[run.path].may_contain(python_label_key({name: value})):
                    return False
        return True

    def logs(self, start: int | None = None, end: int | None = None, labels: dict[str, str] | None = None) -> DataFrame:
        """Entries of the runs that may hold the window and labels, newest version of each."""

        def wanted(r: Run) -> bool:
            if (start is not None and r.max_ts < start) or (end is not None and r.min_ts > end):
                return False
            return self.may_hold(r, labels or {})

        return logs.latest_logs(self._read("log", self._paths("log", wanted)))

    def query(self, query: LogQuery | str, now_nanos: int | None = None, limit: int | None = None) -> DataFrame:
        """The entries that a query finds, in order; all of them where no limit is given."""
        q = parse_query(query) if isinstance(query, str) else query
        now = time.time_ns() if now_nanos is None else now_nanos
        return logs.query_logs(self.logs(*q.window(now), q.labels), q, now, limit).drop("version", *[f"label_{n}" for n in self.options.promoted_labels])

    def query_result(self, query: LogQuery | str, now_nanos: int | None = None, limit: int | None = None) -> dict:
        """The answer of a service: matcher, window, the first entries (a service's limit holds) and whether there are more."""
        q = parse_query(query) if isinstance(query, str) else query
        now, most = time.time_ns() if now_nanos is None else now_nanos, logs.check_limit(limit)
        start, end = q.window(now)
        found = self.query(q, now, most + 1).collect()
        entries = [{"timestamp": format_rfc3339(r.ts_nanos), "labels": dict(sorted(r.labels.items())), "message": r.message, "sequence": r.sequence} for r in found[:most]]
        return {"matcher": q.matcher, "start": format_rfc3339(start), "end": format_rfc3339(end), "entries": entries, "truncated": len(found) > most}

    # runs

    def write_run(self, df: DataFrame, kind: str, level: int, number: int, tasks: int = 1, ranges: list[tuple] | None = None) -> Run | None:
        """Writes sorted rows as one run, cut by key ranges into tasks files; None if there are no rows. What fails leaves no data."""
        order = ["key"] if kind == "kv" else list(LOG_ORDER)
        path = f"run-{number:010d}-{uuid.uuid4().hex[:8]}"
        if ranges and len(ranges) > 1:
            placed = compaction.in_ranges(df, order[0], ranges)
        else:
            placed = df.repartitionByRange(tasks, *order) if tasks > 1 else df.coalesce(1)
        filtered = ["key"] if kind == "kv" else [f"label_{n}" for n in self.options.promoted_labels]
        with self._cleaning(path):
            writer = placed.sortWithinPartitions(*order).write.option("compression", self.options.compression)
            for name in filtered:
                writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
            writer.parquet(self._data(path))
            back = self._read(kind, [path])
            bounds = [F.count("*").alias("n"), F.min(order[0]).alias("low"), F.max(order[0]).alias("high")]
            parts = back.groupBy(F.col("_metadata.file_name").alias("f")).agg(*bounds).orderBy("low").collect()  # a row a file
            n = sum(r.n for r in parts)
            if not n:
                self._delete_data(path)
                return None
            low, high = parts[0].low, max(r.high for r in parts)
            extra: dict = {"first_keys": [r.low for r in parts]}
            if kind == "kv":
                extra |= {"min_key": low, "max_key": high}
            else:
                pairs = back.select(F.explode(F.map_entries("labels")).alias("l")).select("l.key", "l.value").distinct()
                nth = F.row_number().over(Window.partitionBy("key").orderBy("value"))  # Spark cuts each name to that many before the shuffle
                values: dict[str, list[str]] = {}
                for r in pairs.withColumn("nth", nth).where(F.col("nth") <= LISTED_VALUES + 1).collect():
                    values.setdefault(r.key, []).append(r.value)
                wide = sorted(k for k, v in values.items() if len(v) > LISTED_VALUES)
                counts = {k: len(v) for k, v in values.items()}
                if wide:
                    many = pairs.where(F.col("key").isin(wide))
                    counts |= {r[0]: r[1] for r in many.groupBy("key").count().collect()}
                    tokens = many.select(F.concat_ws("=", escaped(F.col("key")), escaped(F.col("value"))).alias("k"))
                    self.files.create(f"{self._data(path)}.bloom", build_bloom(tokens, "k").text())
                values = {k: sorted(v) for k, v in values.items() if k not in wide}
                extra |= {"min_ts": low, "max_ts": high, "labels": counts, "label_values": values, "bloom": bool(wide)}
            return Run(number, kind, level, path, n, self.files.bytes(self._data(path)), **extra)

    def _drop_runs(self, runs: list[Run]) -> None:
        for r in runs:
            self._delete_data(r.path, *([f"{r.path}.bloom"] if r.bloom else []))

    def checkpoint(self) -> None:
        """Turns all changes into runs of level 0 and publishes them; the changes' files go after that."""
        changes = self.manifest.changes
        if not changes:
            return
        runs, number = list(self.manifest.runs), self.manifest.next_id
        with self._cleaning() as made:
            for kind, merge in (("kv", kv.resolve_latest), ("log", logs.latest_logs)):
                own = [c for c in changes if c["kind"] == kind]
                tasks = -(-sum(c["bytes"] for c in own) // RUN_TASK_BYTES)
                if own and (run := self.write_run(merge(self._read(kind, [c["path"] for c in own])), kind, 0, number, tasks)):
                    runs.append(run)
                    made += [run.path, f"{run.path}.bloom"]
                    number += 1
            self._publish(replace(self.manifest, runs=runs, changes=[], next_id=number, counters=self.manifest.counted(checkpoints=1)))
        self._delete_data(*[c["path"] for c in changes])

    def _merge(self, inputs: list[Run], level: int, bottom: bool, now_nanos: int) -> dict:
        kind = inputs[0].kind
        read = self._read(kind, [r.path for r in inputs])
        tasks = compaction.task_count(sum(r.bytes for r in inputs), self.options, self.spark.sparkContext.defaultParallelism)
        ranges = compaction.split_points([k for r in inputs for k in r.first_keys or []], tasks)
        with self._cleaning() as made:
            if kind == "kv":
                merged = compaction.merge_kv(read, bottom=bottom)
            else:
                merged = compaction.merge_logs(read, bottom=bottom, now_nanos=now_nanos, options=replace(self.options, max_size_bytes=0))
                if bottom and self.options.max_size_bytes:  # the cutoff takes several looks: the merge is written once, then cut
                    other = kv.live(self.versions()).agg(F.sum(kv_bytes())).first()[0] or 0
                    staged = f"merge-{uuid.uuid4().hex}"
                    made.append(staged)
                    merged.write.option("compression", self.options.compression).parquet(self._data(staged))
                    merged = retain_size(self._read(kind, [staged]), self.options.max_size_bytes, other)
            run = self.write_run(merged, kind, level, self.manifest.next_id, tasks, ranges if len(ranges) >= tasks else None)
            if run:
                made += [run.path, f"{run.path}.bloom"]
            gone = {r.id for r in inputs}
            runs = [r for r in self.manifest.runs if r.id not in gone] + ([run] if run else [])
            counters = self.manifest.counted(compactions=1, compaction_tasks=tasks, compaction_output_files=len(run.first_keys) if run else 0)
            self._publish(replace(self.manifest, runs=runs, next_id=self.manifest.next_id + 1, counters=counters))
        self._drop_runs(inputs)
        self._delete_data(*[p for p in made if p.startswith("merge-")])
        records = sum(r.records for r in inputs)
        return {"kind": kind, "input_runs": len(inputs), "output_runs": int(bool(run)), "input_records": records, "output_records": run.records if run else 0, "dropped_records": records - (run.records if run else 0), "level": level, "tasks": tasks}

    def compact(self, now_nanos: int | None = None) -> list[dict]:
        """Merges all runs of each kind into one of level 1, without tombstones and with retention. One run with nothing to drop stays."""
        now = time.time_ns() if now_nanos is None else now_nanos
        out = []
        for kind in ("kv", "log"):
            inputs = [r for r in self.manifest.runs if r.kind == kind]
            limited = kind == "log" and (self.options.retention_nanos or self.options.max_size_bytes)
            if len(inputs) > 1 or (inputs and limited):
                out.append(self._merge(inputs, 1, True, now))
        return out

    def compact_level(self, level: int, now_nanos: int | None = None, kinds: tuple[str, ...] = ("kv", "log")) -> list[dict]:
        """Merges a level into the next one; tombstones and old entries go only at the bottom."""
        now = time.time_ns() if now_nanos is None else now_nanos
        bottom = level + 1 >= self.options.max_levels - 1
        out = []
        for kind in kinds:
            if inputs := compaction.select_runs([r for r in self.manifest.runs if r.kind == kind], level):
                out.append(self._merge(inputs, level + 1, bottom, now))
        return out

    def compact_next(self, now_nanos: int | None = None) -> list[dict]:
        """Merges the level that is due, if any, of the first kind that has one; the other kind stays as it is."""
        for kind in ("kv", "log"):
            level = compaction.next_level([r for r in self.manifest.runs if r.kind == kind], self.options)
            if level is not None:
                return self.compact_level(level, now_nanos, (kind,))
        return []

    def orphans(self) -> list[str]:
        """Data that no generation knows of: of writers that are at work, or that died."""
        known = {r.path for r in self.manifest.runs} | {f"{r.path}.bloom" for r in self.manifest.runs if r.bloom} | {c["path"] for c in self.manifest.changes}
        return [n for n in self.files.names(f"{self.path}/data") if n not in known]

    def remove_orphans(self, older_than_seconds: float = 3600) -> list[str]:
        """Deletes orphans that are old enough to have no writer any more."""
        now = time.time_ns() // 1_000_000
        old = [n for n in self.orphans() if self.files.age_seconds(self._data(n), now) >= older_than_seconds]
        self._delete_data(*old)
        return old

    def run_table(self) -> DataFrame:
        """The manifest's runs as a table."""
        rows = [(r.id, r.kind, r.level, r.path, r.records, r.bytes, r.min_key, r.max_key, r.min_ts, r.max_ts) for r in self.manifest.runs]
        return self.spark.createDataFrame(rows, "id long, kind string, level int, path string, records long, bytes long, min_key string, max_key string, min_ts long, max_ts long")
