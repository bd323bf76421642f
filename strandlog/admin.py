"""Verify, repair, back up, restore and upgrade a store."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import LOG_ORDER, Options
from .operators.compaction import Run
from .operators.kv import resolve_latest
from .operators.logs import latest_logs
from .sources.files import Files
from .sources.store import FORMAT, RUN_TASK_BYTES, Manifest, Store


class VerifyError(Exception):
    """A run or backup doesn't hold what its manifest says."""


def check_run(store: Store, run: Run) -> list[str]:
    """What is wrong with a run: its count, its order inside each file, or its range."""
    rows = store._read(run.kind, [run.path])
    keys = ["key"] if run.kind == "kv" else list(LOG_ORDER)
    placed = rows.select(*keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    before = placed.withColumn("before", F.lag(F.struct(*keys)).over(Window.partitionBy("file").orderBy("place")))
    edge = keys[0]
    n, bad, low, high = before.agg(F.count("*"), F.count_if(F.col("before") >= F.struct(*keys)), F.min(edge), F.max(edge)).first()
    problems = []
    if n != run.records:
        problems.append(f"{n} records, the manifest has {run.records}")
    if bad:
        problems.append(f"{bad} rows out of order")
    if (low, high) != (run.low(), run.high()):
        problems.append(f"range {low!r} to {high!r}, the manifest has {run.low()!r} to {run.high()!r}")
    return problems


def check_change(store: Store, change: dict) -> list[str]:
    """What is wrong with a change: that its rows can't all be read, or aren't as many as were written."""
    n, _ = store._read(change["kind"], [change["path"]]).agg(F.count("*"), F.bit_xor(F.xxhash64(*(["key", "value"] if change["kind"] == "kv" else ["label_key", "message"])))).first()
    return [f"{n} records, the manifest has {change['records']}"] if change.get("records") not in (None, 0, n) else []


def _problems(check) -> list[str]:
    try:
        return check()
    except Exception as e:  # noqa: BLE001  an unreadable file is what a verification is for
        return [f"can't be read: {str(e).splitlines()[0][:200]}"]


def verify(store: Store) -> dict:
    """Checks every run and change and reports all that is wrong; VerifyError if anything is."""
    wrong = {r.path: p for r in store.manifest.runs if (p := _problems(lambda r=r: check_run(store, r)))}
    wrong |= {c["path"]: p for c in store.manifest.changes if (p := _problems(lambda c=c: check_change(store, c)))}
    if wrong:
        raise VerifyError(json.dumps(wrong))
    return {"runs": len(store.manifest.runs), "records": sum(r.records for r in store.manifest.runs), "changes": len(store.manifest.changes)}


def repair(spark: SparkSession, path: str, options: Options | None = None) -> dict:
    """Moves runs and changes that fail verification to corrupt/, leaves out missing ones, and publishes what is left.

    The manifest decides what belongs to the store; files that it doesn't name are told and stay where they are. The
    manifest before the repair is kept as a copy.
    """
    store = Store(spark, path, options)
    name = store.files.read(f"{store.path}/CURRENT").strip()
    store.files.create(f"{store.path}/{name}.before-repair-{uuid.uuid4().hex[:8]}", store.manifest.text())
    orphans, quarantined, missing = store.orphans(), [], []

    def sound(path: str, check) -> bool:
        if not store.files.exists(store._data(path)):
            missing.append(path)
            return False
        if not _problems(check):
            return True
        store.files.make(f"{store.path}/corrupt")
        target = path if not store.files.exists(f"{store.path}/corrupt/{path}") else f"{path}-{uuid.uuid4().hex[:8]}"
        store.files.move(store._data(path), f"{store.path}/corrupt/{target}")
        quarantined.append(target)
        return False

    kept = [r for r in store.manifest.runs if sound(r.path, lambda r=r: check_run(store, r))]
    changes = [c for c in store.manifest.changes if sound(c["path"], lambda c=c: check_change(store, c))]
    store._publish(replace(store.manifest, runs=kept, changes=changes))
    return {"kept": len(kept), "changes": len(changes), "quarantined": quarantined, "missing": missing, "orphans": orphans}


#: Files up to this size are hashed by tasks, a file a row; larger ones are streamed by the driver.
ROW_BYTES = 1 << 30


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Size and SHA-256 of every file below a folder: (file, bytes, sha256)."""
    files = Files(spark)
    place = F.regexp_extract("path", r"(/data/.*|/MANIFEST-\d+|/CURRENT)$", 1)
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= ROW_BYTES)
    out = small.select(place.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = [(path, size, files.sha256(path)) for path, size in files.listing(folder) if size > ROW_BYTES]
    if large:
        out = out.unionByName(spark.createDataFrame(large, "path string, bytes long, sha256 string").select(place.alias("file"), "bytes", "sha256"))
    return out


def backup(store: Store, target: str) -> dict:
    """Checkpoints, copies what the manifest names, and lists each file's digest; the target must be new and outside the store."""
    target = target.rstrip("/")
    if store.files.exists(target) or target.startswith(store.path + "/") or target == store.path:
        raise ValueError("the backup's folder must be new and outside the store")
    store.checkpoint()
    part = f"{target}.{uuid.uuid4().hex}.tmp"
    store.files.make(f"{part}/data")
    name = store.files.read(f"{store.path}/CURRENT").strip()
    data = [x for run in store.manifest.runs for x in (run.path, *([f"{run.path}.bloom"] if run.bloom else []))]
    try:
        store.files.copy_all([(f"{store.path}/{f}", f"{part}/{f}") for f in ("CURRENT", name)] + [(store._data(x), f"{part}/data/{x}") for x in data])
        listed = [r.asDict() for r in digests(store.spark, part).orderBy("file").collect()]
        store.files.create(f"{part}/backup.json", json.dumps({"files": listed}))
        store.files.move(part, target)
    except Exception:
        store.files.delete(part)
        raise
    return {"files": len(listed), "bytes": sum(f["bytes"] for f in listed)}


def verify_backup(spark: SparkSession, folder: str) -> dict:
    """Compares sizes and digests with the list and then opens and checks each run; files that the list doesn't have are passed over."""
    files = Files(spark)
    listed = json.loads(files.read(f"{folder}/backup.json"))["files"]
    wanted = spark.createDataFrame([(f["file"], f["bytes"], f["sha256"]) for f in listed], "file string, wanted_bytes long, wanted_sha256 string")
    found = wanted.join(digests(spark, folder), "file", "left")
    wrong = found.where(F.col("bytes").isNull() | (F.col("bytes") != F.col("wanted_bytes")) | (F.col("sha256") != F.col("wanted_sha256"))).select("file").limit(100).collect()
    if wrong:
        raise VerifyError(f"files that differ or are missing: {[r.file for r in wrong]}")
    verify(Store(spark, folder))
    return {"files": len(listed), "runs": len(Manifest.of(files.read(f"{folder}/{files.read(f'{folder}/CURRENT').strip()}")).runs)}


def restore(spark: SparkSession, folder: str, target: str) -> Store:
    """Verifies a backup and copies it to a new folder."""
    files = Files(spark)
    if files.exists(target):
        raise ValueError("the target is there already")
    verify_backup(spark, folder)
    part = f"{target.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    try:
        files.make(part)
        files.copy_all([(f"{folder}/{n}", f"{part}/{n}") for n in files.names(folder) if n not in ("backup.json", "data")])
        files.make(f"{part}/data")
        files.copy_all([(f"{folder}/data/{n}", f"{part}/data/{n}") for n in files.names(f"{folder}/data")])
        files.move(part, target.rstrip("/"))
    except Exception:
        files.delete(part)
        raise
    return Store(spark, target)


def upgrade(store: Store) -> dict:
    """Rewrites runs of an older format, each at its level and in as many tasks as its bytes ask for."""
    store.checkpoint()
    old = [r for r in store.manifest.runs if r.format != FORMAT]
    runs, number = [r for r in store.manifest.runs if r.format == FORMAT], store.manifest.next_id
    with store._cleaning() as made:
        for r in old:
            merge = resolve_latest if r.kind == "kv" else latest_logs
            new = store.write_run(merge(store._read(r.kind, [r.path])), r.kind, r.level, number, -(-r.bytes // RUN_TASK_BYTES))
            if new:
                runs.append(new)
                made += [new.path, f"{new.path}.bloom"]
            number += 1
        if old or store.manifest.format != FORMAT:
            store._publish(replace(store.manifest, runs=runs, next_id=number, format=FORMAT))
    store._drop_runs(old)
    return {"rewritten": len(old)}
