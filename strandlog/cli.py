"""logctl: a thin command line over a store."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from . import admin, stats
from .functions.times import parse_rfc3339
from .model import EngineError, Options
from .sources.json_logs import parse_batch
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logctl", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name, aliases, args in (
        ("get", [], ["key"]), ("put", [], ["key", "value"]), ("del", ["delete"], ["key"]), ("scan", ["kv-scan", "kvscan"], []), ("health", [], []), ("metrics", [], []), ("log", [], ["message"]), ("log-batch", [], ["file"]), ("query", ["logs"], ["query"]),
        ("checkpoint", [], []), ("compact", [], []), ("verify", [], []), ("repair", [], []), ("backup", [], ["folder"]), ("verify-backup", [], ["folder"]), ("restore", [], ["folder"]), ("upgrade", [], []),
    ):
        q = sub.add_parser(name, aliases=aliases)
        q.set_defaults(command=name)
        for a in args:
            q.add_argument(a)
        if name == "scan":
            q.add_argument("--start", default="")
            q.add_argument("--end", default="")
        if name == "log":
            q.add_argument("--label", "-l", action="append", default=[])
            q.add_argument("--timestamp")
        if name == "query":
            q.add_argument("--limit", type=int)
            q.add_argument("--now")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("logctl").getOrCreate()
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x), file=out)
    try:
        if args.command == "restore":
            admin.restore(spark, args.folder, args.store)
            return 0
        if args.command == "verify-backup":
            say(admin.verify_backup(spark, args.folder))
            return 0
        if args.command == "repair":
            say(admin.repair(spark, args.store))
            return 0
        import os

        store = Store(spark, args.store, Options.from_env(dict(os.environ)))
        if args.command == "get":
            value = store.get(args.key)
            if value is None:
                return 1
            say(value)
        elif args.command == "put":
            store.put(args.key, args.value)
        elif args.command == "del":
            store.delete(args.key)
        elif args.command == "scan":
            for row in store.scan(args.start, args.end).toLocalIterator():
                say({"key": row.key, "value": row.value})
        elif args.command == "log":
            ts = parse_rfc3339(args.timestamp) if args.timestamp else time.time_ns()
            store.write_logs([(ts, [tuple(x.split("=", 1)) for x in args.label], args.message, 0)])
        elif args.command == "log-batch":
            store.write_logs(parse_batch(sys.stdin.read() if args.file == "-" else store.files.read(args.file), time.time_ns()))
        elif args.command == "query":
            now = parse_rfc3339(args.now) if args.now else time.time_ns()
            say(store.query_result(args.query, now, args.limit))
        elif args.command == "health":
            ok = stats.healthy(store)
            say({"status": "ok" if ok else "unavailable"})
            return 0 if ok else 1
        elif args.command == "metrics":
            say(stats.prometheus(store).rstrip())
        elif args.command == "checkpoint":
            store.checkpoint()
        elif args.command == "compact":
            say(store.compact())
        elif args.command == "verify":
            say(admin.verify(store))
        elif args.command == "backup":
            say(admin.backup(store, args.folder))
        elif args.command == "upgrade":
            say(admin.upgrade(store))
    except (EngineError, ValueError, admin.VerifyError) as e:
        print(f"logctl: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
