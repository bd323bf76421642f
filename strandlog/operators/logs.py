"""Log queries: a closed time window, label equality, a message pattern, order and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import escaped, has_labels, python_label_key
from ..functions.matcher import contains_pattern, matches
from ..model import DEFAULT_LIMIT, InvalidTimeRange, LOG_ORDER, MAX_LIMIT, InvalidQuery
from ..plans.querylang import LogQuery, parse_query


def logs_view(df: DataFrame, *, ts_nanos: Column, sequence: Column, message: Column, labels: dict[str, Column]) -> DataFrame:
    """Any table as log entries; each label is also a column of its own (label_<name>), so filters on it reach the scan."""
    pairs = [x for name, c in sorted(labels.items()) for x in (F.lit(name), c)]
    found = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    key = F.concat_ws("|", *[F.concat(F.lit(python_label_key({n: ""})), escaped(c)) for n, c in sorted(labels.items())])  # names are known, so no map has to be sorted
    return df.select(ts_nanos.alias("ts_nanos"), found.alias("labels"), sequence.alias("sequence"), message.alias("message"), key.alias("label_key"), *[c.alias(f"label_{n}") for n, c in sorted(labels.items())])


def promoted(logs: DataFrame) -> dict[str, Column]:
    """Labels that have a column of their own."""
    return {c[len("label_") :]: F.col(f"`{c}`") for c in logs.columns if c.startswith("label_") and c != "label_key"}


def in_window(start: int, end: int) -> Column:
    """ts_nanos within a window closed at both ends, bare, so that it is pushed down."""
    if end < start:
        raise InvalidTimeRange("the end is before the start")
    return (F.col("ts_nanos") >= start) & (F.col("ts_nanos") <= end)


def select_logs(logs: DataFrame, start: int, end: int, labels: dict[str, str] | None = None) -> DataFrame:
    """Entries of a closed window whose labels include the given ones, unordered."""
    return logs.where(in_window(start, end) & has_labels(F.col("labels"), labels or {}, promoted(logs)))


def ordered(logs: DataFrame) -> DataFrame:
    return logs.orderBy(*LOG_ORDER)


def query_window(logs: DataFrame, start: int, end: int, labels: dict[str, str] | None = None) -> DataFrame:
    """As select_logs, in the order of time, labels and sequence."""
    return ordered(select_logs(logs, start, end, labels))


def check_limit(limit: int | None) -> int:
    """The limit of the command line and of a service: the default where none is given, else one in range."""
    if limit is None:
        return DEFAULT_LIMIT
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidQuery(f"the limit must be 1 to {MAX_LIMIT}")
    return limit


def query_matches(logs: DataFrame, query: LogQuery | str, now_nanos: int) -> DataFrame:
    """All entries that a query finds, unordered: window and labels first, the pattern anywhere in the message last."""
    q = parse_query(query) if isinstance(query, str) else query
    return select_logs(logs, *q.window(now_nanos), q.labels).where(matches(F.col("message"), contains_pattern(q.matcher)))


def query_logs(logs: DataFrame, query: LogQuery | str, now_nanos: int, limit: int | None = None) -> DataFrame:
    """The entries that a query finds, in order: all of them, or the first ones; the limit counts after the pattern."""
    found = ordered(query_matches(logs, query, now_nanos))
    if limit is not None and limit < 1:
        raise InvalidQuery("the limit must be positive")
    return found if limit is None else found.limit(limit)


def truncated(logs: DataFrame, query: LogQuery | str, now_nanos: int, limit: int | None = None) -> DataFrame:
    """One row: how many entries the limit lets through, and whether there is one more."""
    most = check_limit(limit)
    found = query_matches(logs, query, now_nanos).select(F.lit(1)).limit(most + 1)
    return found.agg(F.least(F.count("*"), F.lit(most)).alias("entries"), (F.count("*") > most).alias("truncated"))


def latest_logs(logs: DataFrame, version: str = "version") -> DataFrame:
    """One entry for each time, label set and sequence: the one with the highest version."""
    rest = [c for c in logs.columns if c not in LOG_ORDER]
    return logs.groupBy(*LOG_ORDER).agg(F.max_by(F.struct(*rest), version).alias("x")).select(*LOG_ORDER, "x.*")


def assign_sequences(logs: DataFrame, last_sequence: int, high: int | None = None) -> DataFrame:
    """Gives entries with sequence 0 the numbers after the largest one known, in the order of time, labels and message.

    A place is the entries of earlier days, of earlier seconds of the day, of earlier nanoseconds and label sets of the
    second, and the rank among its like, so no window holds more than a day's seconds, a second's label sets, or
    the entries of one nanosecond and label set. high: the largest sequence among logs, where it is known.
    """
    if high is None:
        high = logs.agg(F.max("sequence")).first()[0]
    base = max(last_sequence, high or 0)
    second = F.expr("ts_nanos div 1000000000 - CASE WHEN ts_nanos % 1000000000 < 0 THEN 1 ELSE 0 END")
    fresh = logs.where("sequence = 0").withColumn("__second", second)
    alike = fresh.groupBy("__second", "ts_nanos", "label_key").agg(F.count("*").alias("n"))
    seconds = alike.groupBy("__second").agg(F.sum("n").alias("n")).withColumn("day", F.expr("__second div 86400 - CASE WHEN __second % 86400 < 0 THEN 1 ELSE 0 END"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = seconds.groupBy("day").agg(F.sum("n").alias("n")).select("day", before(Window.orderBy("day")).alias("of_day"))
    offsets = seconds.withColumn("of_second", before(Window.partitionBy("day").orderBy("__second"))).join(days, "day").select("__second", (F.col("of_day") + F.col("of_second")).alias("__before"))
    inside = alike.withColumn("__inside", before(Window.partitionBy("__second").orderBy("ts_nanos", "label_key"))).join(offsets, "__second").select("ts_nanos", "label_key", (F.col("__before") + F.col("__inside")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("ts_nanos", "label_key").orderBy("message"))
    numbered = fresh.join(inside, ["ts_nanos", "label_key"]).withColumn("sequence", F.col("__before") + rank + F.lit(base))
    return logs.where("sequence <> 0").unionByName(numbered.select(*logs.columns))
