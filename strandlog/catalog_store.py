"""Registered queries that open real stores: write, checkpoint, reopen, read, compact, ingest and maintain them.

Each makes a store of its own in the folder that driver and executors share, from whole tables, and returns rows that
read it; the folder's owner removes them (they lie below strandlog-<application>/catalog).
"""

from __future__ import annotations

import io
import json
import uuid
from contextlib import redirect_stderr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import admin, cli, stats
from .catalog import _OUT, HOUR, LOGS_SQL, NOW, _query, _select, events
from .functions.bloom import build_bloom
from .functions.labels import check_labels, labels_valid
from .model import Conflict, CorruptStore, DuplicateLabel, EngineError, InvalidEntry, InvalidLabel, InvalidQuery, InvalidRange, Options, status_of
from .operators import compaction, kv
from .operators.compaction import Run
from .plans.querylang import format_query, parse_query
from .sources.files import Files, shared_root
from .sources.json_logs import entries_from_lines, read_batch_file
from .sources.store import Store
from .streaming import ingest


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/strandlog-{spark.sparkContext.applicationId}/catalog/{name}-{uuid.uuid4().hex[:12]}"


def _store(spark, name: str, **options) -> Store:
    return Store(spark, folder(spark, name), Options(**{"auto_checkpoint": False, **options}))


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# keys: all events as operations on their user's key, in two parts: signups come after all others

def operations(spark, d: str, signups: bool) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").where(f"(event_type = 'signup') = {str(signups).lower()}")
    return rows.select(F.col("event_id").alias("op_index"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"))


OPS_SQL = """ops AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted, event_type = 'signup' AS later, event_id FROM events),
latest AS (SELECT key, value, deleted FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY later DESC, event_id DESC) = 1)"""


def key_store(spark, d: str, name: str, runs: int = 1, **options) -> Store:
    """A store of all operations: the first part in a run, the second in a run too (runs = 2) or still a change."""
    store = _store(spark, name, **options)
    for part in (False, True):
        store.write_batch(operations(spark, d, part))
        if part + 1 <= runs:
            store.checkpoint()
    return store


# logs: all events, in two parts likewise; their sequences are the store's

def entries(spark, d: str, signups: bool | None = None, numbered: bool = True) -> DataFrame:
    rows = events(spark, d)
    rows = rows if signups is None else rows.where((F.col("label_event_type") == "signup") == signups)
    return rows.select("ts_nanos", "labels", "label_key", (F.col("sequence") if numbered else F.lit(0).cast("long")).alias("sequence"), "message")


def log_store(spark, d: str, name: str, runs: int = 1, numbered: bool = True, **options) -> Store:
    store = _store(spark, name, **{"promoted_labels": ("event_type",), **options})
    for part in (False, True):
        store.append_logs(entries(spark, d, part, numbered))
        if part + 1 <= runs:
            store.checkpoint()
    return store


@_query("store_scan", f"WITH {OPS_SQL} SELECT key, value FROM latest WHERE NOT deleted")
def store_scan(spark, d):
    """A run and a later change over it: the newest live value of each key."""
    return key_store(spark, d, "scan").scan()


@_query("store_reopen_iterate", f"WITH {OPS_SQL} SELECT row_number() OVER (ORDER BY key) AS place, key, value, deleted FROM latest WHERE key >= 'user/000002'")
def store_reopen_iterate(spark, d):
    """Reopened, and walked in order with its tombstones."""
    made = key_store(spark, d, "iterate")
    walk = Store(spark, made.path, made.options).iterate("user/000002")
    return _rows(spark, [(i + 1, *row) for i, row in enumerate(walk)], "place long, key string, value string, deleted boolean")


@_query("store_put_get_delete", "SELECT r_name AS key, CASE WHEN r_name <> 'ASIA' THEN CAST(r_regionkey AS VARCHAR) END AS value FROM region UNION ALL SELECT 'nowhere', NULL")
def store_put_get_delete(spark, d):
    """Single writes and point reads; a deleted key and one that never was have no value."""
    store = _store(spark, "get")
    names = sorted((r.r_name, r.r_regionkey) for r in spark.read.parquet(f"{d}/region.parquet").select("r_name", "r_regionkey").collect())
    for k, (name, number) in enumerate(names):
        store.put(name, str(number))
        if k == len(names) // 2:
            store.checkpoint()
    for gone in ("ASIA", "nowhere"):
        store.delete(gone)
    return _rows(spark, [(name, store.get(name)) for name, _ in [*names, ("nowhere", 0)]], "key string, value string")


@_query("store_auto_checkpoint", f"WITH {OPS_SQL} SELECT CAST(2 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS changes, CAST((SELECT count(DISTINCT (key, later)) FROM ops) AS BIGINT) AS records")
def store_auto_checkpoint(spark, d):
    """Changes beyond checkpoint_bytes become a run by themselves."""
    m = key_store(spark, d, "auto", runs=0, auto_checkpoint=True, checkpoint_bytes=1).manifest
    return _rows(spark, [(len(m.runs), len(m.changes), sum(r.records for r in m.runs))], "runs long, changes long, records long")


@_query("store_compact_report", f"WITH {OPS_SQL}, n AS (SELECT count(DISTINCT (key, later)) AS before, (SELECT count(*) FROM latest WHERE NOT deleted) AS after FROM ops) SELECT 'kv' AS kind, CAST(2 AS BIGINT) AS input_runs, CAST(1 AS BIGINT) AS output_runs, before AS input_records, after AS output_records, before - after AS dropped_records, CAST(1 AS BIGINT) AS level FROM n")
def store_compact_report(spark, d):
    names = ("kind", "input_runs", "output_runs", "input_records", "output_records", "dropped_records", "level")
    done = key_store(spark, d, "report", runs=2).compact(NOW)
    return _rows(spark, [tuple(r[n] for n in names) for r in done], "kind string, input_runs long, output_runs long, input_records long, output_records long, dropped_records long, level long")


@_query("store_compact_full", f"WITH {OPS_SQL} SELECT key, value, deleted FROM latest WHERE NOT deleted")
def store_compact_full(spark, d):
    """After a full compaction the runs hold live keys only."""
    store = key_store(spark, d, "full", runs=2)
    store.compact(NOW)
    return store.versions().select("key", "value", "deleted")


@_query("store_compact_level", f"WITH {OPS_SQL} SELECT key, value, deleted FROM latest")
def store_compact_level(spark, d):
    """Level 0 merged into level 1, above the bottom: one version a key, tombstones stay."""
    store = key_store(spark, d, "level", runs=2)
    store.compact_level(0, NOW)
    return store.versions().select("key", "value", "deleted")


@_query("store_compact_next", "SELECT * FROM (VALUES (1, 'kv', 0, 2), (2, 'log', 0, 2), (3, NULL, NULL, NULL)) t(step, kind, level, input_runs)")
def store_compact_next(spark, d):
    """One kind is due at a time, and the other one's runs stay: keys first, then logs, then nothing."""
    store = key_store(spark, d, "next", runs=2, compaction_threshold=2)
    for part in (False, True):
        store.append_logs(entries(spark, d, part))
        store.checkpoint()
    out = []
    for step in (1, 2, 3):
        done = store.compact_next(NOW)
        out += [(step, r["kind"], r["level"] - 1, r["input_runs"]) for r in done] or [(step, None, None, None)]
    return _rows(spark, out, "step int, kind string, level int, input_runs int")


@_query("merge_plan", "SELECT * FROM (VALUES (0, 1, NULL), (8388608, 1, NULL), (8388609, 2, 'm'), (20000000, 3, 'h r'), (100000000, 3, 'h r'), (5368709120, 5, 'e h m r')) t(bytes, tasks, cuts)")
def merge_plan(spark, d):
    """Tasks of a merge by its bytes with three workers, and the keys that its ranges are cut at."""
    keys, options = list("aehmrz"), Options(compaction_workers=3)
    out = []
    for size in (0, 8 << 20, (8 << 20) + 1, 20_000_000, 100_000_000, 5 << 30):
        tasks = compaction.task_count(size, options)
        out.append((size, tasks, " ".join(low for low, _ in compaction.split_points(keys, tasks)[1:]) or None))
    return _rows(spark, out, "bytes long, tasks int, cuts string")


@_query("store_merge_ranges", f"WITH {OPS_SQL} SELECT count(*) AS records, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS out_of_order FROM latest WHERE NOT deleted")
def store_merge_ranges(spark, d):
    """A merge by planned key ranges: files of one run don't overlap and are sorted."""
    store = key_store(spark, d, "ranges", runs=2, compaction_workers=3, compaction_task_bytes=1)
    for k, run in enumerate(store.manifest.runs):  # as if the runs had come from merges into several files
        marks = [r.key for r in store._read("kv", [run.path]).select("key").orderBy("key").collect()]
        store.manifest.runs[k] = Run(**{**run.__dict__, "first_keys": marks[:: max(1, len(marks) // 3)]})
    store.compact(NOW)
    run = store.manifest.runs[0]
    files = store.versions().groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    overlaps = sum(a.high >= b.low for a, b in zip(files, files[1:])) + (0 if len(files) == min(3, run.records) else 1)
    return _rows(spark, [(sum(f.n for f in files), overlaps, len(admin.check_run(store, run)))], "records long, overlaps long, out_of_order long")


@_query("store_log_query", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs WHERE ts_nanos BETWEEN {NOW - 400 * HOUR} AND {NOW} AND event_type = 'click' AND contains(message, '7')")
def store_log_query(spark, d):
    """A query expression over a run and a change; all that it finds."""
    return _select(log_store(spark, d, "query").query('"7"{event_type=click}[400h]', NOW))


@_query("store_log_envelope", f"""WITH {LOGS_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY ts_nanos, label_key, sequence) AS place FROM logs WHERE ts_nanos BETWEEN {NOW - 480 * HOUR} AND {NOW} AND event_type = 'view')
SELECT place, strftime(make_timestamp(ts_nanos // 1000), '%Y-%m-%dT%H:%M:%S') AS second, message, sequence, (SELECT count(*) > 50 FROM f) AS truncated, '%' AS matcher, '2024-01-11T00:00:00Z' AS from_time, '2024-01-31T00:00:00Z' AS to_time FROM f WHERE place <= 50""")
def store_log_envelope(spark, d):
    """The answer of a service, with its limit."""
    told = log_store(spark, d, "envelope").query_result('"%"{event_type=view}[480h]', NOW, 50)
    rows = [(i + 1, e["timestamp"][:19], e["message"], e["sequence"], told["truncated"], told["matcher"], told["start"], told["end"]) for i, e in enumerate(told["entries"])]
    return _rows(spark, rows, "place long, second string, message string, sequence long, truncated boolean, matcher string, from_time string, to_time string")


@_query("store_sequences", f"WITH {LOGS_SQL} SELECT ts_nanos, label_key, message, row_number() OVER (ORDER BY event_type = 'signup', ts_nanos, label_key, message) AS sequence FROM logs")
def store_sequences(spark, d):
    """Entries without sequences, in two writes with a checkpoint and a reopening between them: numbers go on where they were."""
    store = _store(spark, "sequences")
    store.append_logs(entries(spark, d, False, numbered=False))
    store.checkpoint()
    again = Store(spark, store.path, store.options)
    again.append_logs(entries(spark, d, True, numbered=False))
    return again.logs().select("ts_nanos", "label_key", "message", "sequence")


@_query("store_overwritten_entries", f"WITH {LOGS_SQL} SELECT ts_nanos, label_key, sequence, CASE WHEN event_type = 'signup' THEN 'again' ELSE message END AS message FROM logs")
def store_overwritten_entries(spark, d):
    """An entry of the same time, labels and sequence replaces the one before it, over runs too."""
    store = log_store(spark, d, "overwrite", runs=2)
    store.append_logs(entries(spark, d, True).withColumn("message", F.lit("again")))
    store.compact(NOW)
    return _select(store.logs())


@_query("store_retention_time", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs WHERE ts_nanos >= {NOW - 300 * HOUR}")
def store_retention_time(spark, d):
    store = log_store(spark, d, "retention", runs=2, retention_nanos=300 * HOUR)
    store.compact(NOW)
    return _select(store.logs())


@_query("store_size_cap", f"""WITH {LOGS_SQL}, {OPS_SQL}, k AS (SELECT sum(strlen(key) + strlen(value) + 13) AS size FROM latest WHERE NOT deleted),
s AS (SELECT *, sum(44 + strlen(label_key) + strlen(message)) OVER (ORDER BY ts_nanos DESC, label_key DESC, sequence DESC) AS newer FROM logs) SELECT {_OUT} FROM s, k WHERE newer + k.size <= 60000""")
def store_size_cap(spark, d):
    """One cap over keys and logs: the oldest entries go until both fit."""
    store = key_store(spark, d, "cap", runs=2, max_size_bytes=60_000)
    for part in (False, True):
        store.append_logs(entries(spark, d, part))
        store.checkpoint()
    store.compact(NOW)
    return _select(store.logs())


@_query("store_conflict", f"WITH {OPS_SQL} SELECT CAST(3 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS orphans, count(*) AS keys FROM latest WHERE NOT deleted")
def store_conflict(spark, d):
    """Of two writers one gets a conflict, whatever it does, and leaves no data behind."""
    store = key_store(spark, d, "conflict")
    stale = Store(spark, store.path, store.options)
    store.put("user/000000x", "1")
    store.delete("user/000000x")
    conflicts = 0
    for act in (lambda: stale.put("user/000000y", "1"), stale.checkpoint, lambda: stale.append_logs(entries(spark, d))):
        try:
            act()
        except Conflict:
            conflicts += 1
    return _rows(spark, [(conflicts, len(store.orphans()), store.scan().count())], "conflicts long, orphans long, keys long")


@_query("store_generations", "SELECT CAST(5 AS BIGINT) AS generation, CAST(2 AS BIGINT) AS manifests, CAST(5 AS BIGINT) AS current")
def store_generations(spark, d):
    """Every write, checkpoint and merge is a generation; the last two are kept, CURRENT names the newest."""
    store = key_store(spark, d, "generations", runs=2)
    store.compact(NOW)
    names = [n for n in store.files.names(store.path) if n.startswith("MANIFEST-")]
    current = store.files.read(f"{store.path}/CURRENT").strip()
    return _rows(spark, [(Store(spark, store.path).manifest.generation, len(names), int(current.removeprefix("MANIFEST-")))], "generation long, manifests long, current long")


# ingest

def json_lines(spark, d: str) -> DataFrame:
    """Every event as a JSON entry."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return rows.select("event_type", F.to_json(F.struct(stamp.alias("timestamp"), F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string")).alias("labels"), F.col("props").alias("message"), (F.col("event_id") + 1).alias("sequence"))).alias("value"))


@_query("json_entries", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs")
def json_entries(spark, d):
    return _select(entries_from_lines(json_lines(spark, d), NOW).where("error is null"))


@_query("json_errors", "SELECT CASE event_type WHEN 'error' THEN 'no message' WHEN 'click' THEN 'bad label' WHEN 'signup' THEN 'bad sequence' WHEN 'purchase' THEN 'unknown field' ELSE 'none' END AS error, count(*) AS n FROM events GROUP BY 1")
def json_errors(spark, d):
    """Fields of the wrong JSON type: a number as the message, a number as a label, a fraction as the sequence, a field too many."""
    line = F.col("value")
    for kind, shape, new in (("error", r'"message":"(?:[^"\\]|\\.)*"', '"message":5'), ("click", r'"user_id":"(\d+)"', '"user_id":$1'), ("signup", r'"sequence":(\d+)', '"sequence":$1.5'), ("purchase", r"^\{", '{"more":1,')):
        line = F.when(F.col("event_type") == kind, F.regexp_replace("value", shape, new)).otherwise(line)
    found = entries_from_lines(json_lines(spark, d).select(line.alias("value")), NOW)
    return found.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@_query("json_batch_files", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs")
def json_batch_files(spark, d):
    """A batch object a file, one for each type of event."""
    path = folder(spark, "batches")
    bodies = json_lines(spark, d).groupBy("event_type").agg(F.concat(F.lit('{"entries":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    bodies.repartition("event_type").select("value", "event_type").write.partitionBy("event_type").text(path)
    return _select(read_batch_file(spark, f"{path}/event_type=*/part-*", NOW))


@_query("stream_ingest", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs UNION ALL SELECT ts_nanos + 1, label_key, sequence, message FROM logs")
def stream_ingest(spark, d):
    """Two streams into one store, each started twice: every entry is there once."""
    store, at = _store(spark, "stream"), folder(spark, "lines")
    lines = json_lines(spark, d).select("value")
    lines.write.text(f"{at}/a")
    lines.withColumn("value", F.regexp_replace("value", r'(\.\d{6})Z"', '$1001Z"')).write.text(f"{at}/b")
    for _ in range(2):
        for name in ("a", "b"):
            ingest.ingest(ingest.read_lines(spark, f"{at}/{name}"), store, f"{at}/checkpoint-{name}").awaitTermination()
    return _select(store.logs())


@_query("stream_label_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS from_time, event_type AS value, count(*) AS entries FROM events GROUP BY 1, 2")
def stream_label_rates(spark, d):
    out = ingest.label_rates(events(spark, d), "event_type", "1 hour")
    return out.select(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + (start - TIMESTAMP'1970-01-01 00:00:00Z')").alias("from_time"), "value", "entries")


# metadata

def busy_store(spark, d: str, name: str) -> Store:
    """Keys and logs, three checkpoints, a merge of the keys, and a change that is still one."""
    store = key_store(spark, d, name, runs=2)
    store.append_logs(entries(spark, d, False))
    store.checkpoint()
    store.compact_level(0, NOW, ("kv",))
    store.append_logs(entries(spark, d, True))
    return store


_BUSY = f"{LOGS_SQL}, {OPS_SQL}, n AS (SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_type = 'signup') AS signups, (SELECT count(*) FROM latest) AS keys)"


@_query("store_metrics", f"""WITH {_BUSY} SELECT unnest(['write_operations_total', 'write_batches_total', 'checkpoints_total', 'compactions_total', 'compaction_tasks_total', 'compaction_output_files_total', 'runs', 'records', 'changes', 'change_records', 'streams', 'generation', 'last_sequence', 'last_error', 'level_runs{{level="0"}}', 'level_runs{{level="1"}}']) AS name,
CAST(unnest([2 * events, 4, 3, 1, 1, 1, 2, keys + events - signups, 1, signups, 0, 8, events, 0, 1, 1]) AS BIGINT) AS value FROM n""")
def store_metrics(spark, d):
    """The text export, read back; families whose values hang on file sizes or on the process are left out."""
    text = stats.prometheus(busy_store(spark, d, "metrics"))
    rows = [line.removeprefix(stats.PREFIX).rsplit(" ", 1) for line in text.splitlines() if not line.startswith("#")]
    wanted = {n for n, _, _ in stats.FAMILIES} - {"read_operations_total", "runs_read_total", "runs_skipped_total", "bytes", "change_bytes", "last_version"}
    return _rows(spark, [(n, int(v)) for n, v in rows if n.split("{")[0] in wanted | {"level_runs"}], "name string, value long")


@_query("stats_by_level", f"WITH {_BUSY} SELECT 0 AS level, CAST(1 AS BIGINT) AS files, events - signups AS records FROM n UNION ALL SELECT 1, 1, keys FROM n")
def stats_by_level(spark, d):
    return stats.levels(busy_store(spark, d, "levels")).select("level", "files", "records")


@_query("store_runs", f"""WITH {_BUSY} SELECT 'kv' AS kind, 1 AS level, (SELECT count(*) FROM latest) AS records, (SELECT min(key) FROM latest) AS min_key, (SELECT max(key) FROM latest) AS max_key, NULL::BIGINT AS min_ts, NULL::BIGINT AS max_ts
UNION ALL SELECT 'log', 0, count(*), NULL, NULL, min(ts_nanos), max(ts_nanos) FROM logs WHERE event_type <> 'signup'""")
def store_runs(spark, d):
    """The manifest's runs as it tells of them."""
    return busy_store(spark, d, "runs").run_table().select("kind", "level", "records", "min_key", "max_key", "min_ts", "max_ts")


@_query("store_label_filter", "SELECT count(DISTINCT user_id) AS label_values, count(DISTINCT user_id) AS may_hold, true AS other_label_skips, count(DISTINCT event_type) AS listed FROM events WHERE event_type <> 'signup'")
def store_label_filter(spark, d):
    """No label value of a run is ever denied by what the manifest keeps of it."""
    store = log_store(spark, d, "filter")
    run = store.manifest.runs[0]
    users = [r[0] for r in spark.read.parquet(f"{d}/events.parquet").where("event_type <> 'signup'").select(F.col("user_id").cast("string")).distinct().collect()]
    held = sum(store.may_hold(run, {"user_id": u}) for u in users)
    return _rows(spark, [(run.labels["user_id"], held, not store.may_hold(run, {"host": "x"}), len(run.label_values["event_type"]))], "label_values long, may_hold long, other_label_skips boolean, listed long")


@_query("bloom_filter", "WITH k AS (SELECT DISTINCT text FROM documents WHERE text <> ''), n AS (SELECT count(*) AS n FROM k) SELECT n AS keys, n AS found, CAST(ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / 64) * 64 AS BIGINT) AS bits, CAST(greatest(1, round(ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / 64) * 64 / n * ln(2))) AS BIGINT) AS hashes FROM n")
def bloom_filter(spark, d):
    """A filter over all different texts, built in the cluster, has every one of them. It is as large as the texts ask for: ten bits each."""
    texts = spark.read.parquet(f"{d}/documents.parquet").where("text <> ''").select("text").distinct()
    own = build_bloom(texts, "text", 0.01, 1 << 40)

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(own.may_contain_each(batch.column(0).to_pylist()))], names=["found"])

    found = texts.mapInArrow(look, "found boolean")
    return found.agg(F.count("*").alias("keys"), F.count_if("found").alias("found")).select("keys", "found", F.lit(own.bits).cast("long").alias("bits"), F.lit(own.hashes).cast("long").alias("hashes"))


# maintenance

@_query("verify_store", f"WITH {_BUSY} SELECT CAST(2 AS BIGINT) AS runs, keys + events - signups AS records, CAST(1 AS BIGINT) AS changes FROM n")
def verify_store(spark, d):
    told = admin.verify(busy_store(spark, d, "verify"))
    return _rows(spark, [(told["runs"], told["records"], told["changes"])], "runs long, records long, changes long")


def damaged(spark, d: str, name: str) -> Store:
    """A store whose first run can't be read and whose logs are gone."""
    store = key_store(spark, d, name, runs=2)
    store.append_logs(entries(spark, d))
    store.checkpoint()
    first, _, gone = store.manifest.runs
    for path, _ in store.files.listing(store._data(first.path)):
        if path.endswith(".parquet"):
            store.files.replace(path, "not what was written")
    store.files.delete(store._data(gone.path))
    store.files.make(store._data("left-by-a-dead-writer"))
    return store


@_query("repair_store", "SELECT CAST(1 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS quarantined, CAST(1 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS orphans, CAST(2 AS BIGINT) AS found_wrong")
def repair_store(spark, d):
    store = damaged(spark, d, "repair")
    try:
        wrong = admin.verify(store) and 0
    except admin.VerifyError as e:
        wrong = len(json.loads(str(e)))
    told = admin.repair(spark, store.path, store.options)
    return _rows(spark, [(told["kept"], len(told["quarantined"]), len(told["missing"]), len(told["orphans"]), wrong)], "kept long, quarantined long, missing long, orphans long, found_wrong long")


@_query("repair_store_rows", f"WITH {OPS_SQL} SELECT key, value FROM ops WHERE later QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1")
def repair_store_rows(spark, d):
    """What is left is what the sound run has."""
    store = damaged(spark, d, "repaired")
    admin.repair(spark, store.path, store.options)
    return Store(spark, store.path).scan()


@_query("backup_restore", f"WITH {OPS_SQL} SELECT key, value, deleted FROM latest")
def backup_restore(spark, d):
    """Backed up, verified, restored: the same newest versions."""
    store = key_store(spark, d, "backup")
    target = folder(spark, "target")
    admin.backup(store, target)
    admin.verify_backup(spark, target)
    return kv.resolve_latest(admin.restore(spark, target, folder(spark, "restored")).versions()).select("key", "value", "deleted")


@_query("backup_digest", "SELECT true AS listed, true AS same_bytes, true AS same_digest, true AS change_is_found")
def backup_digest(spark, d):
    """The list of a backup against digests that the driver streams of the store's own files, and of a file changed later."""
    store = key_store(spark, d, "digest")
    target = folder(spark, "digests")
    admin.backup(store, target)
    files = Files(spark)
    listed = {f["file"]: f for f in json.loads(files.read(f"{target}/backup.json"))["files"]}
    own = {p[p.index("/data/") :]: (n, files.sha256(p)) for p, n in files.listing(f"{store.path}/data") if "/_" not in p}
    both = {f: listed[f] for f in listed if f.startswith("/data/")}
    same = [all(own[f][k] == both[f][n] for f in both) for k, n in enumerate(("bytes", "sha256"))]
    files.replace(f"{target}/data{sorted(f for f in both if f.endswith('.parquet'))[0].removeprefix('/data')}", "changed")
    try:
        admin.verify_backup(spark, target)
        found = False
    except admin.VerifyError:
        found = True
    return _rows(spark, [(set(both) == set(own), *same, found)], "listed boolean, same_bytes boolean, same_digest boolean, change_is_found boolean")


@_query("upgrade_store", f"WITH {OPS_SQL} SELECT CAST(2 AS BIGINT) AS rewritten, CAST(0 AS BIGINT) AS again, count(DISTINCT (key, later)) AS records, CAST(0 AS BIGINT) AS older FROM ops")
def upgrade_store(spark, d):
    """Runs of an older format are rewritten at their levels, once."""
    store = key_store(spark, d, "upgrade", runs=2)
    store.manifest.runs[:] = [Run(**{**r.__dict__, "format": 0}) for r in store.manifest.runs]
    first, second = admin.upgrade(store)["rewritten"], admin.upgrade(store)["rewritten"]
    runs = Store(spark, store.path).manifest.runs
    return _rows(spark, [(first, second, sum(r.records for r in runs), sum(r.format == 0 for r in runs))], "rewritten long, again long, records long, older long")


# surface

@_query("store_health", "SELECT * FROM (VALUES ('open', true), ('a run is gone', false), ('the manifest is gone', false)) t(state, healthy)")
def store_health(spark, d):
    store = key_store(spark, d, "health", runs=2)
    out = [("open", stats.healthy(store))]
    store.files.move(store._data(store.manifest.runs[0].path), f"{store.path}/elsewhere")
    out.append(("a run is gone", stats.healthy(store)))
    store.files.move(f"{store.path}/elsewhere", store._data(store.manifest.runs[0].path))
    store.files.replace(f"{store.path}/CURRENT", "MANIFEST-none")
    out.append(("the manifest is gone", stats.healthy(store)))
    return _rows(spark, out, "state string, healthy boolean")


@_query("error_status", "SELECT * FROM (VALUES ('query', 400), ('range', 400), ('entry', 400), ('label twice', 400), ('damage', 503), ('second writer', 409), ('anything else', 500)) t(error, status)")
def error_status(spark, d):
    kinds = {"query": InvalidQuery(), "range": InvalidRange(), "entry": InvalidEntry(), "label twice": DuplicateLabel(), "damage": CorruptStore(), "second writer": Conflict(), "anything else": RuntimeError()}
    return _rows(spark, [(k, status_of(e)) for k, e in kinds.items()], "error string, status int")


@_query("settings_from_variables", "SELECT * FROM (VALUES ('unset', '4'), ('MAX_LEVELS=6', '6'), ('MAX_LEVELS=many', '4'), ('MAX_LEVELS=1', 'refused'), ('COMPRESSION= ZSTD ', 'zstd'), ('COMPRESSION=rar', 'refused'), ('AUTO_CHECKPOINT=0', 'False'), ('COMPACTION_THRESHOLD=-1', 'refused')) t(variable, became)")
def settings_from_variables(spark, d):
    """Values that can't be read fall back, values out of range are refused."""
    out = []
    for case in ("unset", "MAX_LEVELS=6", "MAX_LEVELS=many", "MAX_LEVELS=1", "COMPRESSION= ZSTD ", "COMPRESSION=rar", "AUTO_CHECKPOINT=0", "COMPACTION_THRESHOLD=-1"):
        name, _, value = case.partition("=")
        try:
            made = Options.from_env({f"STRANDLOG_{name}": value} if value else {})
            out.append((case, str(getattr(made, name.lower() if value else "max_levels"))))
        except EngineError:
            out.append((case, "refused"))
    return _rows(spark, out, "variable string, became string")


def _call(spark, path: str, *args: str) -> tuple[int, str]:
    out, told = io.StringIO(), io.StringIO()
    with redirect_stderr(told):
        code = cli.main(["--store", path, *args], spark, out)
    return code, out.getvalue().strip()


@_query("cli_keys", """SELECT * FROM (VALUES (1, 0, ''), (2, 0, ''), (3, 0, 'one'), (4, 0, '{"key": "a/b", "value": "one"}' || chr(10) || '{"key": "c", "value": "two"}'), (5, 0, ''), (6, 1, ''), (7, 0, '{"key": "c", "value": "two"}'), (8, 2, '')) t(step, code, said)""")
def cli_keys(spark, d):
    """put, get, scan and delete on the command line; an absent key, and a range the wrong way round."""
    path = folder(spark, "cli")
    calls = [("put", "a/b", "one"), ("put", "c", "two"), ("get", "a/b"), ("scan",), ("delete", "a/b"), ("get", "a/b"), ("kv-scan", "--start", "a"), ("scan", "--start", "z", "--end", "a")]
    return _rows(spark, [(i + 1, *_call(spark, path, *c)) for i, c in enumerate(calls)], "step int, code int, said string")


@_query("cli_logs", """SELECT * FROM (VALUES (1, 0, NULL, NULL, NULL), (2, 0, NULL, NULL, NULL), (3, 0, 'disk full', 1, false), (4, 0, 'disk slow', 2, true), (5, 2, NULL, NULL, NULL)) t(step, code, message, sequence, truncated)""")
def cli_logs(spark, d):
    """log and query on the command line: what was found first, and whether there is more."""
    path, out = folder(spark, "cli"), []
    now = ("--now", "2024-01-01T10:01:00Z")
    calls = [("log", "disk full", "-l", "app=db", "--timestamp", "2024-01-01T10:00:00Z"), ("log", "disk slow", "-l", "app=web", "--timestamp", "2024-01-01T09:00:00Z"), ("query", "full{app=db}[5m]", *now), ("logs", "disk{}[2h]", "--limit", "1", *now), ("query", "disk{", *now)]
    for i, c in enumerate(calls):
        code, said = _call(spark, path, *c)
        found = json.loads(said) if said else None
        first = found["entries"][0] if found else {}
        out.append((i + 1, code, first.get("message"), first.get("sequence"), found and found["truncated"]))
    return _rows(spark, out, "step int, code int, message string, sequence int, truncated boolean")


@_query("cli_maintenance", "SELECT * FROM (VALUES (1, 'checkpoint', 0), (2, 'compact', 0), (3, 'verify', 0), (4, 'backup', 0), (5, 'verify-backup', 0), (6, 'repair', 0), (7, 'upgrade', 0), (8, 'health', 0), (9, 'metrics', 0), (10, 'restore', 2), (11, 'backup', 2)) t(step, command, code)")
def cli_maintenance(spark, d):
    """Every maintenance command on a whole store; restoring over a store, and a backup that is there already, are refused."""
    store = key_store(spark, d, "cli")
    target = folder(spark, "cli-backup")
    calls = [("checkpoint",), ("compact",), ("verify",), ("backup", target), ("verify-backup", target), ("repair",), ("upgrade",), ("health",), ("metrics",), ("restore", target), ("backup", target)]
    return _rows(spark, [(i + 1, c[0], _call(spark, store.path, *c)[0]) for i, c in enumerate(calls)], "step int, command string, code int")


@_query("query_text", """SELECT * FROM (VALUES ('error{}[5m]', '"error"{}[5m]', 300000000000, 0), ('"a b"{z=1,y="q"}[1h30m] offset 90s', '"a b"{y="q",z="1"}[1h30m] offset 1m30s', 5400000000000, 90000000000), ('x{}[0.5s]', '"x"{}[500ms]', 500000000, 0)) t(given, formatted, range_nanos, offset_nanos)""")
def query_text(spark, d):
    """Expressions parsed and formatted again."""
    out = []
    for given in ("error{}[5m]", '"a b"{z=1,y="q"}[1h30m] offset 90s', "x{}[0.5s]"):
        q = parse_query(given)
        assert parse_query(format_query(q)) == q
        out.append((given, format_query(q), q.range_nanos, q.offset_nanos))
    return _rows(spark, out, "given string, formatted string, range_nanos long, offset_nanos long")


@_query("label_check", "SELECT event_type <> 'error' AND NOT contains(props, '7') AS valid, count(*) AS n FROM events GROUP BY 1")
def label_check(spark, d):
    """Label sets with an empty name for errors and a NUL in values with a 7; the check of tables and the one of single entries agree."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("name"), F.replace("props", F.lit("7"), F.lit("\0")).alias("value"))
    for name, value in {tuple(r) for r in rows.distinct().collect()}:
        try:
            ok = bool(check_labels([(name, value)]))
        except InvalidLabel:
            ok = False
        if ok != (bool(name) and "\0" not in value):
            raise ValueError(f"the checks differ on {name!r}")
    return rows.groupBy(labels_valid(F.create_map("name", "value")).alias("valid")).agg(F.count("*").alias("n"))


@_query("log_batch_limits", f"WITH {LOGS_SQL} SELECT count(*) AS entries, count(*) > 10 AS truncated_at_ten, count(*) AS without_limit FROM logs WHERE event_type = 'purchase'")
def log_batch_limits(spark, d):
    """A store's query has no limit of its own; a service's has."""
    store = log_store(spark, d, "limits")
    found = store.query('"%"{event_type=purchase}[2000h]', NOW + 1000 * HOUR)
    return found.agg(F.count("*").alias("entries"), F.count("*").alias("without_limit")).withColumn("truncated_at_ten", F.lit(store.query_result('"%"{event_type=purchase}[2000h]', NOW + 1000 * HOUR, 10)["truncated"]))



