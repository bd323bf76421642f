"""The store: writes, reads, checkpoints, compaction, ingest, maintenance and the command line."""

import glob
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandlog import admin, catalog, cli, stats
from strandlog.functions.bloom import FNV_BASIS, FNV_PRIME, BloomFilter, best_size, fnv
from strandlog.model import Conflict, CorruptStore, InvalidEntry, InvalidOptions, InvalidRange, InvalidTimeRange, Options
from strandlog.operators import kv, logs, retention
from strandlog.operators.compaction import Run, level_capacity, next_level, select_runs, split_points, task_count
from strandlog.sources.json_logs import entries_from_lines, parse_batch, read_batch_file
from strandlog.sources.store import Store
from strandlog.streaming.ingest import ingest, label_rates, read_lines

BASE = 1_704_103_200_000_000_000
MINUTE = 60 * 10**9
ENTRIES = [(BASE, {"level": "ERROR", "app": "nginx"}, "nginx failed", 0), (BASE + MINUTE, {"app": "api", "level": "ERROR"}, "api failed", 0), (BASE + 2 * MINUTE, {"level": "INFO", "app": "nginx"}, "nginx ready", 0)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", Options(auto_checkpoint=False, promoted_labels=("app",)))


def messages(df):
    return [r.message for r in df.collect()]


def test_keys_overwrite_delete_and_scan(store):
    store.write_batch([("put", "a", "old"), ("put", "b", "old"), ("put", "c", "old")])
    store.checkpoint()
    store.write_batch([("put", "b", "new"), ("delete", "c", None), ("put", "d", "new"), ("put", "e/f", "")])
    assert [tuple(r) for r in store.scan("b", "e").collect()] == [("b", "new"), ("d", "new")]
    assert store.get("c") is None and store.get("e/f") == "" and store.get("a") == "old"
    again = Store(store.spark, store.path, store.options)
    assert again.get("b") == "new"
    assert [r.deleted for r in kv.scan_raw(again.versions(), "c", "d").collect()] == [True]
    with pytest.raises(InvalidRange):
        store.scan("x", "a")


def test_a_batch_is_checked_whole_and_ordered(store):
    store.write_batch([("put", "a", "old"), ("put", "b", "b" * 5000), ("put", "a", "new"), ("delete", "a", None)])
    assert store.get("a") is None and len(store.get("b")) == 5000
    for bad in ([("put", "x", "1"), ("put", "", "2")], [("put", "x", None)], [("drop", "x", "1")]):
        with pytest.raises(InvalidEntry):
            store.write_batch(bad)
    store.write_batch([])
    assert store.get("x") is None


def test_logs_by_window_labels_and_pattern(store):
    store.write_logs(ENTRIES[:2])
    store.checkpoint()
    store.write_logs(ENTRIES[2:])
    now = BASE + 2 * MINUTE
    assert messages(store.query("nginx{app=nginx}[2m]", now)) == ["nginx failed", "nginx ready"]
    assert messages(store.query('"%"{app=nginx,level=ERROR}[2m]', now)) == ["nginx failed"]
    assert messages(store.query('"%"{}[1m] offset 1m', now)) == ["nginx failed", "api failed"]
    assert messages(store.query('"%"{host=""}[2m]', now, 1)) == ["nginx failed"]
    assert [r.sequence for r in store.query('"%"{}[2m]', now).collect()] == [1, 2, 3]
    assert logs.truncated(store.logs(), '"%"{}[2m]', now, 2).first().truncated
    with pytest.raises(InvalidTimeRange):
        logs.in_window(2, 1)
    with pytest.raises(ValueError):
        store.query('"%"{}[2m]', now, 0)
    first = store.query_result('"%"{}[2m]', now, 2)
    assert first["truncated"] and [e["message"] for e in first["entries"]] == ["nginx failed", "api failed"] and first["start"] == "2024-01-01T10:00:00Z" and first["entries"][0]["labels"] == {"app": "nginx", "level": "ERROR"}
    assert not store.query_result('"%"{}[2m]', now)["truncated"]
    for limit in (0, 10_001):
        with pytest.raises(ValueError):
            store.query_result('"%"{}[2m]', now, limit)


def test_the_same_log_key_is_overwritten(store):
    store.write_logs([(BASE, {"a": "1"}, "first", 9)])
    store.write_logs([(BASE, {"a": "1"}, "second", 9), (BASE, {"a": "1"}, "other", 0)])
    assert [(r.message, r.sequence) for r in store.query('"%"{}[1m]', BASE).collect()] == [("second", 9), ("other", 10)]


def test_compaction_keeps_what_reads_see(store):
    for i in range(4):
        store.write_batch([("put", f"k{j}", f"{i}") for j in range(i, 20, i + 1)] + [("delete", f"k{i}", None)])
        store.write_logs([(BASE + i * MINUTE, {"app": str(i)}, f"m{i}", 0)])
        store.checkpoint()
    before, before_logs = store.scan().collect(), messages(store.query('"%"{}[1h]', BASE + 4 * MINUTE))
    done = store.compact_next(BASE)
    assert [(d["kind"], d["level"]) for d in done] == [("kv", 1)] and {(r.kind, r.level) for r in store.manifest.runs} == {("kv", 1), ("log", 0)}
    assert [(d["kind"], d["level"]) for d in store.compact_next(BASE)] == [("log", 1)] and {r.level for r in store.manifest.runs} == {1} and store.compact_next(BASE) == []
    assert store.scan().collect() == before and messages(store.query('"%"{}[1h]', BASE + 4 * MINUTE)) == before_logs
    assert kv.resolve_latest(store.versions()).where("deleted").count() > 0  # above the bottom tombstones stay
    store.write_batch([("delete", "k19", None)])
    store.checkpoint()
    store.compact(BASE)
    assert kv.resolve_latest(store.versions()).where("deleted").count() == 0 and store.get("k19") is None
    assert store.compact(BASE) == []
    assert admin.verify(store)["runs"] == len(store.manifest.runs)


def test_retention(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Options(auto_checkpoint=False, retention_nanos=2 * MINUTE))
    store.write_logs([(BASE + i * MINUTE, {}, f"m{i}", 0) for i in range(5)])
    store.checkpoint()
    store.compact(BASE + 4 * MINUTE)
    assert messages(logs.ordered(store.logs())) == ["m2", "m3", "m4"]  # exactly as old stays
    rows = store.logs()
    assert messages(logs.ordered(retention.retain_size(rows, 2 * 46))) == ["m3", "m4"]
    assert retention.retain_size(rows, 3 * 46, other_bytes=46).count() == 2 and retention.retain_size(rows, 1).count() == 0 and retention.retain_size(rows, 0).count() == 3


def test_choice_of_runs():
    def run(i, level, low, high, size=10):
        return Run(i, "kv", level, f"r{i}", 1, size, low, high)

    held = [run(1, 0, "a", "c"), run(2, 0, "b", "f"), run(3, 1, "e", "g"), run(4, 1, "h", "z"), run(5, 2, "a", "z")]
    assert [r.id for r in select_runs(held, 0)] == [1, 2, 3] and [r.id for r in select_runs(held, 1)] == [3, 5] and select_runs(held, 3) == []
    assert next_level(held, Options(compaction_threshold=2)) == 0 and next_level(held, Options(compaction_threshold=0)) is None
    assert next_level(held, Options(compaction_threshold=0, level_base_bytes=19)) == 1
    assert level_capacity(3, Options(level_base_bytes=2, level_multiplier=3)) == 18 and level_capacity(99, Options()) == (1 << 63) - 1
    assert task_count(0, Options()) == 1 and task_count(17 << 20, Options()) == 3 and task_count(1 << 30, Options(compaction_workers=4)) == 4 and task_count(1 << 30, Options(), 200) == 128
    assert task_count(1 << 40, Options(compaction_workers=4)) == 1024  # no task takes more than TASK_LIMIT
    assert split_points(["d", "b", "c", "a", "b"], 2) == [(None, "c"), ("c", None)] and split_points(["a"], 4) == [(None, None)] and split_points(["a", "b"], 9) == [(None, "b"), ("b", None)]


def test_a_second_writer_conflicts(store):
    other = Store(store.spark, store.path, store.options)
    store.put("a", "1")
    with pytest.raises(Conflict):
        other.put("a", "2")
    assert Store(store.spark, store.path, store.options).get("a") == "1"


def test_json_batches(spark, tmp_path):
    body = json.dumps({"entries": [{"message": "", "labels": {"a": "1"}, "timestamp": "2024-01-01T10:00:00.000000001Z"}, {"message": "x", "sequence": 5}]})
    assert parse_batch(body, 77) == [(BASE + 1, {"a": "1"}, "", 0), (77, {}, "x", 5)]
    for bad in ("[]", "{}", "[{}]", '[{"message":"x","more":1}]', '[{"message":"x","timestamp":"now"}]', '[{"message":"x","labels":{"":"1"}}]', '[{"message":"x","sequence":-1}]', "nope"):
        with pytest.raises(InvalidEntry):
            parse_batch(bad, 0)
    (tmp_path / "b.json").write_text(body)
    rows = read_batch_file(spark, str(tmp_path / "b.json"), 77).orderBy("sequence").collect()
    assert [(r.ts_nanos, r.labels, r.message, r.sequence) for r in rows] == parse_batch(body, 77)
    (tmp_path / "c.json").write_text('[{"message":"x"},{"msg":"y"}]')
    with pytest.raises(Exception, match="unknown field"):
        read_batch_file(spark, str(tmp_path / "c.json"), 77).collect()


#: Lines that neither path takes, and lines that both do.
BAD_LINES = ['{"message": 5}', '{"message": {"a": "b"}}', '{"message": null}', "{}", '{"message": "x", "labels": {"a": 7}}', '{"message": "x", "labels": {"a": null}}', '{"message": "x", "labels": {"a": {"b": "c"}}}', '{"message": "x", "labels": ["a"]}', '{"message": "x", "labels": "a"}', '{"message": "x", "labels": {"": "1"}}', '{"message": "x", "sequence": 1.5}', '{"message": "x", "sequence": 1.0}', '{"message": "x", "sequence": "1"}', '{"message": "x", "sequence": true}', '{"message": "x", "sequence": -1}', '{"message": "x", "sequence": 9223372036854775808}', '{"message": "x", "timestamp": 5}', '{"message": "x", "timestamp": "soon"}', '{"message": "x", "more": 1}', "[]", "5", "nope", "", '{"message": "x"']
GOOD_LINES = ['{"message": "x"}', '{"message": "", "labels": null, "sequence": null, "timestamp": null}', '{"message": "5", "labels": {"a": "7", "b": ""}, "sequence": 9223372036854775807}', '{"message": "{\\"a\\": 1}", "labels": {}, "sequence": 0, "timestamp": "2024-01-01T12:00:00.5+02:00"}', '{"message": "\\u00e9\\n😀", "labels": {"ö": "x|y=%"}}']


def test_both_json_paths_are_as_strict(spark):
    rows = entries_from_lines(spark.createDataFrame([(i, x) for i, x in enumerate(BAD_LINES + GOOD_LINES)], "i int, value string").coalesce(1), 77).collect()
    assert [r.error is None for r in rows] == [False] * len(BAD_LINES) + [True] * len(GOOD_LINES), [r.error for r in rows]
    for line in BAD_LINES:
        with pytest.raises(InvalidEntry):
            parse_batch(f"[{line}]", 77)
    want = [parse_batch(f"[{line}]", 77)[0] for line in GOOD_LINES]
    assert [(r.ts_nanos, r.labels, r.message, r.sequence) for r in rows[len(BAD_LINES) :]] == want


def test_streams_are_written_exactly_once(spark, tmp_path, store):
    """Two streams, a new checkpoint for one of them, and a crash between a batch's write and the stream's own mark."""
    lines = {f: "\n".join(json.dumps({"message": f"{f}{i}", "timestamp": f"2024-01-01T10:0{i}:00Z"}) for i in range(3)) for f in ("a", "b")}
    for f, text in lines.items():
        (tmp_path / f).mkdir()
        (tmp_path / f / "1.json").write_text(text)
        ingest(read_lines(spark, str(tmp_path / f)), store, str(tmp_path / f"checkpoint-{f}")).awaitTermination()
    assert sorted(messages(store.logs())) == ["a0", "a1", "a2", "b0", "b1", "b2"] and len(store.manifest.streams) == 2
    commits = tmp_path / "checkpoint-a" / "commits"
    for f in commits.iterdir():  # as if the stream had died before it noted its batch as done
        f.unlink()
    again = Store(spark, store.path, store.options)
    ingest(read_lines(spark, str(tmp_path / "a")), again, str(tmp_path / "checkpoint-a")).awaitTermination()
    assert again.logs().count() == 6
    ingest(read_lines(spark, str(tmp_path / "b")), again, str(tmp_path / "checkpoint-new")).awaitTermination()
    assert again.logs().count() == 9 and len(again.manifest.streams) == 3  # a new checkpoint reads its folder anew
    assert again.append_logs(again.logs().limit(1), "s", 4) and not again.append_logs(again.logs().limit(1), "s", 4)
    (tmp_path / "a" / "2.json").write_text('{"message": "late", "sequence": 99}\n{"message": 7}')
    query = ingest(read_lines(spark, str(tmp_path / "a")), again, str(tmp_path / "checkpoint-a"))
    with pytest.raises(Exception, match="no message"):
        query.awaitTermination()
    assert again.logs().where("message = 'late'").isEmpty()
    ingest(read_lines(spark, str(tmp_path / "a")), again, str(tmp_path / "checkpoint-a"), on_error="skip").awaitTermination()
    assert again.logs().where("message = 'late'").count() == 1


def test_what_fails_leaves_nothing_behind(spark, store, monkeypatch):
    store.write_batch([("put", "a", "1")])
    store.checkpoint()
    store.write_batch([("put", "b", "1")])
    other = Store(spark, store.path, store.options)
    store.put("c", "1")
    before = store.files.names(f"{store.path}/data")
    for act in (lambda: other.put("d", "2"), other.checkpoint):
        with pytest.raises(Conflict):
            act()
        assert store.files.names(f"{store.path}/data") == before and stats.snapshot(other)["last_error"] == 1
    store.checkpoint()
    old = Store(spark, store.path, store.options)
    store.put("e", "1")
    with pytest.raises(Conflict):
        old.compact(BASE)
    assert store.orphans() == [] and {r[0] for r in store.iterate()} == {"a", "b", "c", "e"}
    store.files.make(f"{store.path}/data/run-of-a-dead-writer")
    assert store.orphans() == ["run-of-a-dead-writer"] and store.remove_orphans() == [] and store.remove_orphans(0) == ["run-of-a-dead-writer"] and store.get("a") == "1"


def test_a_writer_that_dies_while_publishing(spark, store, monkeypatch):
    """Before its manifest is whole nothing has happened; after that the write holds, though CURRENT is behind."""
    store.put("a", "1")
    behind = store.files.read(f"{store.path}/CURRENT")
    monkeypatch.setattr(type(store.files), "replace", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    store.put("b", "2")
    assert "CURRENT is behind" in store.last_error
    monkeypatch.undo()
    assert store.files.read(f"{store.path}/CURRENT") == behind
    again = Store(spark, store.path, store.options)
    assert again.get("b") == "2" and again.files.read(f"{store.path}/CURRENT") > behind
    torn = f"{store.path}/MANIFEST-{again.manifest.generation + 1:020d}"
    store.files.create(torn, '{"generation": ')
    third = Store(spark, store.path, store.options)
    assert third.manifest.generation == again.manifest.generation
    with pytest.raises(Conflict):  # it may be at it still
        third.put("c", "3")
    monkeypatch.setattr("strandlog.sources.store.TORN_SECONDS", -1)
    fourth = Store(spark, store.path, store.options)
    fourth.put("c", "3")
    assert Store(spark, store.path, store.options).get("c") == "3"


def test_the_lazy_iterator_keeps_tombstones(store):
    store.write_batch([("put", f"k{i}", str(i)) for i in range(9)])
    store.checkpoint()
    store.write_batch([("delete", "k3", None), ("put", "k4", "new")])
    walk = store.iterate("k2", "k6")
    assert next(walk) == ("k2", "2", False) and list(walk) == [("k3", None, True), ("k4", "new", False), ("k5", "5", False)]


def test_bloom_hashes_of_keys_of_any_length_at_once():
    draw = random.Random(1)
    keys = [draw.randbytes(draw.choice([0, 0, 1, 2, 3, 8, 50, 300])) for _ in range(500)] + [draw.randbytes(1_500_000), b"", draw.randbytes(9), b""]
    for xor_first in (True, False):
        want = []
        for key in keys:
            h = FNV_BASIS
            for c in key:
                h = ((h ^ c) * FNV_PRIME if xor_first else h * FNV_PRIME ^ c) % (1 << 64)
            want.append(h)
        assert fnv(keys, xor_first).tolist() == want
    own = BloomFilter.sized(1000, 0.01)
    own.add(f"key-{i}" for i in range(0, 1000, 2))
    asked = [*(f"key-{i}" for i in range(1000)), "", "é"]
    assert own.may_contain_each(asked).tolist() == [own.may_contain(k) for k in asked] and own.may_contain_each([]).tolist() == []


def test_the_bloom_query_over_more_texts_than_a_megabyte_holds(spark, tmp_path):
    """Its size is that of its SQL, however many texts there are."""
    n = 900_000
    spark.range(n).selectExpr("cast(id as string) as text").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["bloom_filter"](spark, str(tmp_path)).collect()] == [(n, n, *best_size(n, 0.01))]


def test_bloom_filters():
    own = BloomFilter.sized(1000, 0.01)
    assert best_size(1000, 0.01) == (own.bits, own.hashes) == (9600, 7) and own.false_positive_rate() == 0
    own.add(f"key-{i}" for i in range(1000))
    own.add([""])
    assert all(own.may_contain(f"key-{i}") for i in range(1000)) and not own.may_contain("") and own.count == 1000
    assert sum(own.may_contain(f"no-{i}") for i in range(10_000)) < 250 and 0.005 < own.false_positive_rate() < 0.02
    back = BloomFilter.of(own.text())
    assert all(back.may_contain(f"key-{i}") == own.may_contain(f"key-{i}") for i in range(3000))
    # the hashes by their definition, byte by byte
    for key in (b"", b"a", "größe".encode(), b"x" * 40):
        one = two = FNV_BASIS
        for c in key:
            one, two = (one ^ c) * FNV_PRIME % (1 << 64), two * FNV_PRIME % (1 << 64) ^ c
        assert (int(fnv([b"pad", key], True)[1]), int(fnv([b"pad", key], False)[1])) == (one, two)
    own.reset()
    assert not own.may_contain("key-1") and own.count == 0
    for bad in ((0, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(InvalidOptions):
            best_size(*bad)


def test_labels_of_many_values_skip_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Options(auto_checkpoint=False))
    for run in range(2):
        rows = spark.range(1500).selectExpr(f"id + {BASE} AS ts_nanos", f"map('user', concat('{run}-', id), 'app', 'x') AS labels", f"concat('app=x|user={run}-', id) AS label_key", "0L AS sequence", "'m' AS message")
        store.append_logs(rows)
        store.checkpoint()
    assert [r.bloom for r in store.manifest.runs] == [True, True] and all("user" not in r.label_values for r in store.manifest.runs)
    assert all(store.may_hold(r, {"user": f"{k}-{i}"}) for k, r in enumerate(store.manifest.runs) for i in range(1500))
    assert sum(store.may_hold(store.manifest.runs[0], {"user": f"1-{i}"}) for i in range(1500)) < 60
    store.reads.update(runs_read=0, runs_skipped=0)
    again = Store(spark, store.path, store.options)
    assert again.query('"%"{user="1-7"}[1h]', BASE + 10**9).count() == 1 and (again.reads["runs_read"], again.reads["runs_skipped"]) == (1, 1)
    assert stats.snapshot(again)["runs_skipped_total"] == 1
    again.compact(BASE)
    assert [r.bloom for r in again.manifest.runs] == [True] and again.orphans() == []


def test_merges_are_dealt_by_the_files_first_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Options(auto_checkpoint=False, compaction_task_bytes=2000, compaction_workers=3))
    for k in range(2):
        store.write_batch(spark.range(4000).selectExpr("id AS op_index", "'put' AS op", f"concat('k', lpad(id * 2 + {k}, 6, '0')) AS key", f"repeat(uuid(), {k + 1}) AS value"))
        store.checkpoint()
        store.manifest.runs[k] = Run(**{**store.manifest.runs[k].__dict__, "first_keys": [f"k{i:06d}" for i in range(k, 8000, 1000)]})
    store.compact(BASE)
    run = store.manifest.runs[0]
    assert len(run.first_keys) == 3 and run.first_keys == sorted(run.first_keys) and run.records == 8000 and admin.verify(store)["records"] == 8000
    names = store.versions().select("key", F.input_file_name().alias("f")).groupBy("f").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
    assert all(a.high < b.low for a, b in zip(names, names[1:])) and [r.low for r in names] == run.first_keys


def test_streaming_equals_batch(spark, tmp_path, store):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"message": f"m{i}", "labels": {"app": str(i % 2)}, "timestamp": f"2024-01-01T10:0{i}:00Z"}) for i in range(6)]
    (folder / "1.json").write_text("\n".join(lines[:3]))
    for part in (lines[3:], None):
        q = ingest(read_lines(spark, str(folder)), store, str(tmp_path / "checkpoint"))
        q.awaitTermination()
        if part:
            (folder / "2.json").write_text("\n".join(part))
    rows = store.query('"%"{}[1h]', BASE + 6 * MINUTE).collect()
    assert [r.message for r in rows] == [f"m{i}" for i in range(6)] and sorted(r.sequence for r in rows) == [1, 2, 3, 4, 5, 6]
    rates = label_rates(store.logs(), "app").orderBy("start", "value").collect()
    assert [(r.value, r.entries) for r in rates] == [("0", 3), ("1", 2), ("1", 1)]
    (folder / "3.json").write_text('{"message": 5, "x": 1}')
    q = ingest(read_lines(spark, str(folder)), store, str(tmp_path / "checkpoint"), on_error="skip")
    q.awaitTermination()
    assert store.logs().count() == 6


def test_backup_restore_repair(spark, tmp_path, store):
    store.write_batch([("put", "a", "1"), ("put", "b", "2")])
    store.write_logs(ENTRIES)
    target = f"file://{tmp_path}/backup"
    admin.backup(store, target)
    assert admin.verify_backup(spark, target)["runs"] == 2
    with pytest.raises(ValueError):
        admin.backup(store, target)
    restored = admin.restore(spark, target, f"file://{tmp_path}/restored")
    assert restored.get("a") == "1" and restored.logs().count() == 3
    def damage(path):
        part = glob.glob(f"{tmp_path}/{path}/part*")[0]
        os.remove(os.path.join(os.path.dirname(part), "." + os.path.basename(part) + ".crc"))
        with open(part, "r+b") as f:
            f.write(b"broken")

    store.put("c", "3")
    store.put("d", "4")
    data = [r for r in store.manifest.runs if r.kind == "kv"][0]
    damage(f"store/data/{data.path}")
    damage(f"store/data/{store.manifest.changes[0]['path']}")
    store.files.make(f"{store.path}/data/nobody-s")
    with pytest.raises(admin.VerifyError) as e:
        admin.verify(store)
    assert set(json.loads(str(e.value))) == {data.path, store.manifest.changes[0]["path"]}
    told = admin.repair(spark, store.path, store.options)
    assert set(told["quarantined"]) == {data.path, store.manifest.changes[0]["path"]} and told["orphans"] == ["nobody-s"] and (told["kept"], told["changes"], told["missing"]) == (1, 1, [])
    again = Store(spark, store.path, store.options)
    assert again.get("a") is None and again.get("c") is None and again.get("d") == "4" and again.logs().count() == 3 and admin.verify(again)["runs"] == 1
    # a backup whose list was made to fit a run with a wrong count is found out by opening the run
    manifest = glob.glob(f"{tmp_path}/backup/MANIFEST-*")[0]
    whole = open(manifest).read()
    for f in glob.glob(f"{tmp_path}/backup/.*.crc"):
        os.remove(f)
    with open(manifest, "w") as f:
        f.write(whole.replace('"records": 3', '"records": 4'))
    listed = json.load(open(f"{tmp_path}/backup/backup.json"))
    for x in listed["files"]:
        if "MANIFEST" in x["file"]:
            x["bytes"], x["sha256"] = os.path.getsize(manifest), hashlib.sha256(open(manifest, "rb").read()).hexdigest()
    json.dump(listed, open(f"{tmp_path}/backup/backup.json", "w"))
    with pytest.raises(admin.VerifyError, match="3 records"):
        admin.verify_backup(spark, target)
    with open(glob.glob(f"{tmp_path}/backup/data/*/part*")[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception):
        admin.verify_backup(spark, target)
    assert admin.Files(spark).sha256(manifest) == hashlib.sha256(open(manifest, "rb").read()).hexdigest()


def test_upgrade_stats_and_broken_manifest(spark, tmp_path, store):
    store.put("a", "1")
    store.checkpoint()
    store.manifest.runs[0] = Run(**{**store.manifest.runs[0].__dict__, "format": 0})
    assert admin.upgrade(store) == {"rewritten": 1} and admin.upgrade(store) == {"rewritten": 0} and store.get("a") == "1"
    text = stats.prometheus(store)
    assert "logengine_runs 1\n" in text and 'logengine_level_runs{level="0"} 1' in text and stats.healthy(store)
    assert [tuple(r)[:3] for r in stats.levels(store).collect()] == [(0, 1, 1)]
    store.files.replace(f"{store.path}/CURRENT", "MANIFEST-nothing")
    with pytest.raises(CorruptStore):
        Store(spark, store.path)
    assert not stats.healthy(store)


def test_command_line(spark, tmp_path):
    root = ["--store", f"file://{tmp_path}/cli"]
    out = io.StringIO()
    assert cli.main([*root, "put", "k/1", "v"], spark) == 0 and cli.main([*root, "get", "k/1"], spark, out) == 0 and out.getvalue() == "v\n"
    assert cli.main([*root, "delete", "k/1"], spark) == 0 and cli.main([*root, "get", "k/1"], spark) == 1
    assert cli.main([*root, "log", "disk full", "-l", "app=db", "--timestamp", "2024-01-01T10:00:00Z"], spark) == 0
    out = io.StringIO()
    assert cli.main([*root, "query", "disk{app=db}[1m]", "--now", "2024-01-01T10:00:30Z"], spark, out) == 0
    found = json.loads(out.getvalue())
    assert found["entries"][0]["timestamp"] == "2024-01-01T10:00:00Z" and found["truncated"] is False
    assert cli.main([*root, "query", "disk{", "--now", "2024-01-01T10:00:30Z"], spark) == 2 and cli.main([*root, "health"], spark, io.StringIO()) == 0
