"""Counters of a store, as rows and in the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators.runs import stats_by_level
from .sources.store import Store

PREFIX = "logengine_"
#: Families in the order of the export: (name, kind, what it counts).
FAMILIES = (
    ("write_operations_total", "counter", "entries and key operations written"),
    ("write_batches_total", "counter", "changes written"),
    ("read_operations_total", "counter", "reads of this process"),
    ("runs_read_total", "counter", "runs that those reads opened"),
    ("runs_skipped_total", "counter", "runs that they skipped by range, label or filter"),
    ("checkpoints_total", "counter", "checkpoints"),
    ("compactions_total", "counter", "merges of runs"),
    ("compaction_tasks_total", "counter", "tasks of those merges"),
    ("compaction_output_files_total", "counter", "files that they published"),
    ("runs", "gauge", "runs in the manifest"),
    ("records", "gauge", "records in runs"),
    ("bytes", "gauge", "bytes of runs"),
    ("changes", "gauge", "changes not yet in a run"),
    ("change_records", "gauge", "records of those changes"),
    ("change_bytes", "gauge", "bytes of those changes"),
    ("streams", "gauge", "streams that have written"),
    ("generation", "counter", "published generations"),
    ("last_sequence", "counter", "highest log sequence"),
    ("last_version", "counter", "highest key version"),
    ("last_error", "gauge", "1 if the last write or merge of this process failed"),
)


def snapshot(store: Store) -> dict[str, int]:
    """Every family's value, and nothing else."""
    m = store.manifest
    kept = {f"{k}_total": m.counters.get(k, 0) for k in ("write_operations", "write_batches", "checkpoints", "compactions", "compaction_tasks", "compaction_output_files")}
    return kept | {f"{k}_total": v for k, v in store.reads.items()} | {
        "runs": len(m.runs), "records": sum(r.records for r in m.runs), "bytes": sum(r.bytes for r in m.runs), "changes": len(m.changes), "change_records": sum(c.get("records", 0) for c in m.changes), "change_bytes": sum(c["bytes"] for c in m.changes), "streams": len(m.streams),
        "generation": m.generation, "last_sequence": m.last_sequence, "last_version": m.last_version, "last_error": int(store.last_error is not None),
    }


def levels(store: Store) -> DataFrame:
    return stats_by_level(store.run_table()).orderBy("level")


def prometheus(store: Store) -> str:
    values = snapshot(store)
    lines = []
    for name, kind, what in FAMILIES:
        lines += [f"# HELP {PREFIX}{name} {what}", f"# TYPE {PREFIX}{name} {kind}", f"{PREFIX}{name} {values[name]}"]
    lines += [f"# HELP {PREFIX}level_runs runs of each level", f"# TYPE {PREFIX}level_runs gauge"]
    by_level: dict[int, int] = {}
    for r in store.manifest.runs:
        by_level[r.level] = by_level.get(r.level, 0) + 1
    lines += [f'{PREFIX}level_runs{{level="{k}"}} {by_level[k]}' for k in sorted(by_level)]
    return "\n".join(lines) + "\n"


def healthy(store: Store) -> bool:
    """Whether the manifest can be read and its runs are there."""
    try:
        return all(store.files.exists(f"{store.path}/data/{r.path}") for r in store.load().runs)
    except Exception:  # noqa: BLE001  whatever stops a read makes the store unhealthy
        return False
