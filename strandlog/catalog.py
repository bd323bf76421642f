"""The engine's registered queries, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import label_key, label_map
from .functions.matcher import matches, to_regex
from .functions.times import parse_rfc3339, rfc3339_nanos
from .operators import compaction, kv, logs, retention, runs
from .sources import changelog

HOUR = 3_600_000_000_000
NOW = parse_rfc3339("2024-01-31T00:00:00Z")
DOCS_EPOCH = 1_700_000_000_000_000_000

_Q: dict = {}
_S: dict = {}


def _query(name: str, sql: str):
    def keep(f):
        _Q[name], _S[name] = f, sql
        return f

    return keep


def _nanos(ts: str = "ts") -> Column:
    """Nanoseconds of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + (CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00')) * 1000")


def events(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """events as logs. A window also bounds the stored timestamps, so the scan skips row groups outside it."""
    raw = spark.read.parquet(f"{d}/events.parquet")
    if start is not None:
        at = lambda n: F.expr(f"CAST(TIMESTAMP_NTZ'1970-01-01 00:00:00' + INTERVAL {n // 1000} MICROSECONDS AS TIMESTAMP_NTZ)")
        raw = raw.where((F.col("ts") >= at(start)) & (F.col("ts") <= at(end)))
    return logs.logs_view(raw, ts_nanos=_nanos(), sequence=F.col("event_id") + 1, message=F.col("props"), labels={"event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")})


def documents(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/documents.parquet")
    return logs.logs_view(raw, ts_nanos=F.col("doc_id") * 1_000_000_000 + DOCS_EPOCH, sequence=F.col("doc_id"), message=F.col("text"), labels={"lang": F.col("lang"), "source": F.col("source")})


def keys(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    return raw.select(F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("version"))


#: SQL of the views above, as CTEs.
LOGS_SQL = "logs AS (SELECT epoch_ns(ts) AS ts_nanos, 'event_type=' || event_type || '|user_id=' || user_id AS label_key, event_type, CAST(user_id AS VARCHAR) AS user_id, event_id + 1 AS sequence, props AS message FROM events)"
DOCS_SQL = f"docs AS (SELECT doc_id * 1000000000 + {DOCS_EPOCH} AS ts_nanos, 'lang=' || lang || '|source=' || source AS label_key, lang, source, doc_id AS sequence, text AS message FROM documents)"
KEYS_SQL = "kv AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted, event_id AS version FROM events), latest AS (SELECT key, value, deleted, version FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1)"
OUT = ("ts_nanos", "label_key", "sequence", "message")
_OUT = ", ".join(OUT)


def _select(df: DataFrame) -> DataFrame:
    return df.select(*OUT)


def _logs(name: str, text: str, where: str, limit: int | None = None):
    """A log query over events by its expression, with the SQL of its window, labels and pattern."""
    from .plans.querylang import parse_query

    q = parse_query(text)
    start, end = q.window(NOW)

    def run(spark, d):
        rows = events(spark, d, start, end)
        return _select(logs.query_logs(rows, q, NOW, limit) if limit else logs.ordered(logs.query_matches(rows, q, NOW)))

    tail = f" ORDER BY ts_nanos, label_key, sequence LIMIT {limit}" if limit else ""
    _query(name, f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs WHERE ts_nanos BETWEEN {start} AND {end} AND {where}{tail}")(run)


_logs("logs_match_contains", '"9"{event_type=error}[240h]', "event_type = 'error' AND contains(message, '9')")
_logs("logs_offset_window", '"%"{}[48h] offset 100h', "true")
_logs("logs_label_one", '"%"{event_type=click}[480h]', "event_type = 'click'")
_logs("logs_label_two", '"%"{event_type=view,user_id="12"}[720h]', "event_type = 'view' AND user_id = '12'")
_logs("logs_label_empty", '"k"{}[24h]', "contains(message, 'k')")
_logs("logs_label_missing_is_empty", '"%"{host=""}[24h]', "true")
_logs("logs_label_value_empty", '"%"{event_type=""}[24h]', "event_type = ''")
_logs("logs_match_class", '": [13579]}"{}[240h]', "regexp_matches(message, ': [13579]}')")
_logs("logs_match_underscore", '"k_: 4_"{}[240h]', "message LIKE '%k_: 4_%'")
_logs("logs_match_never_empty_class", '"9[]"{}[240h]', "false")
_logs("logs_match_never_unclosed", '"9[1"{}[240h]', "false")
_logs("logs_limit", '"%"{event_type=signup}[480h]', "event_type = 'signup'", limit=25)


@_query("logs_window_closed", f"WITH {LOGS_SQL}, b AS (SELECT min(ts_nanos) FILTER (sequence = 101) AS s, max(ts_nanos) FILTER (sequence = 201) AS e FROM logs) SELECT {_OUT} FROM logs, b WHERE ts_nanos BETWEEN s AND e")
def logs_window_closed(spark, d):
    """Bounds are those of two real entries: both ends belong to the window."""
    at = {r.sequence: r.ts_nanos for r in events(spark, d).where(F.col("sequence").isin(101, 201)).collect()}
    return _select(logs.query_window(events(spark, d, at[101], at[201]), at[101], at[201]))


@_query("logs_hour_ties", f"WITH {LOGS_SQL} SELECT ts_nanos // {HOUR} * {HOUR} AS ts_nanos, label_key, sequence, message FROM logs ORDER BY 1, 2, 3")
def logs_hour_ties(spark, d):
    """Times cut to the hour: order falls to labels and sequence, for every event."""
    return _select(logs.ordered(events(spark, d).withColumn("ts_nanos", F.expr(f"ts_nanos div {HOUR} * {HOUR}"))))


@_query("logs_truncated", f"WITH {LOGS_SQL} SELECT least(count(*), 100) AS entries, count(*) > 100 AS truncated FROM logs WHERE ts_nanos BETWEEN {NOW - 480 * HOUR} AND {NOW} AND event_type = 'view'")
def logs_truncated(spark, d):
    return logs.truncated(events(spark, d, NOW - 480 * HOUR, NOW), '"%"{event_type=view}[480h]', NOW, 100)


def _docs(name: str, pattern: str, labels: dict[str, str], where: str):
    @_query(name, f"WITH {DOCS_SQL} SELECT ts_nanos, label_key, sequence FROM docs WHERE {where}")
    def run(spark, d):
        rows = logs.select_logs(documents(spark, d), DOCS_EPOCH, DOCS_EPOCH + 10**18, labels)
        return logs.ordered(rows.where(matches(F.col("message"), pattern))).select("ts_nanos", "label_key", "sequence")


def _like(pattern: str) -> str:
    regex = to_regex(pattern)
    return "regexp_matches(message, '" + regex.replace("'", "''") + "')"


_docs("logs_match_prefix", "Th%", {"lang": "en"}, "lang = 'en' AND message LIKE 'Th%'")
_docs("logs_match_suffix_class", "%[.!?]", {}, _like("%[.!?]"))
_docs("logs_match_suffix", "%the.", {}, "message LIKE '%the.'")
_docs("logs_match_unicode", "%é_è%", {"lang": "fr"}, "lang = 'fr' AND " + _like("%é_è%"))
_docs("logs_match_literal_backslash", "%\\%", {}, "contains(message, chr(92))")
_docs("logs_match_lone_bracket", "%]%", {}, "contains(message, ']')")
_docs("logs_match_middle", "T%e.", {}, _like("T%e."))


@_query("log_label_key", r"SELECT doc_id, 'a=' || replace(replace(replace(text, '%', '%25'), '|', '%7C'), '=', '%3D') || '|lang=' || lang AS label_key FROM documents WHERE text IS NOT NULL")
def log_label_key(spark, d):
    """Label sets with awkward values, whole texts, in canonical text."""
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return rows.select("doc_id", label_key(F.create_map(F.lit("lang"), F.col("lang"), F.lit("a"), F.col("text"))).alias("label_key"))


@_query("log_label_roundtrip", "SELECT doc_id, text AS a, lang FROM documents WHERE text IS NOT NULL")
def log_label_roundtrip(spark, d):
    """Canonical text decoded back to labels."""
    back = label_map(F.col("label_key"))
    return log_label_key(spark, d).select("doc_id", back["a"].alias("a"), back["lang"].alias("lang"))


@_query("log_time_parse", "SELECT event_id, epoch_ns(ts) + event_id % 1000 AS ts_nanos FROM events")
def log_time_parse(spark, d):
    """RFC 3339 texts with nine digits of a second to nanoseconds."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    digits = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    return rows.select("event_id", rfc3339_nanos(F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), digits, F.lit("Z"))).alias("ts_nanos"))


@_query("log_upsert_same_key", f"WITH {LOGS_SQL} SELECT ts_nanos // {24 * HOUR} * {24 * HOUR} AS ts_nanos, 'event_type=' || event_type AS label_key, 1 AS sequence, arg_max(message, sequence) AS message FROM logs GROUP BY 1, 2")
def log_upsert_same_key(spark, d):
    """Entries of one time, label set and sequence: the last one written stays."""
    rows = events(spark, d).select(F.expr(f"ts_nanos div {24 * HOUR} * {24 * HOUR}").alias("ts_nanos"), F.concat(F.lit("event_type="), F.col("label_event_type")).alias("label_key"), F.lit(1).cast("long").alias("sequence"), "message", F.col("sequence").alias("version"))
    return _select(logs.latest_logs(rows))


@_query("log_sequence_assign", f"WITH {LOGS_SQL} SELECT ts_nanos, label_key, message, CASE WHEN sequence % 3 = 0 THEN sequence ELSE (SELECT max(sequence) FROM logs WHERE sequence % 3 = 0) + row_number() OVER (PARTITION BY sequence % 3 = 0 ORDER BY ts_nanos, label_key, message) END AS sequence FROM logs")
def log_sequence_assign(spark, d):
    """Two thirds of the entries come without a sequence."""
    rows = events(spark, d).withColumn("sequence", F.when(F.col("sequence") % 3 == 0, F.col("sequence")).otherwise(0))
    return _select(logs.assign_sequences(rows.select("ts_nanos", "labels", "label_key", "sequence", "message"), 7))


_query("kv_get", f"WITH {KEYS_SQL} SELECT key, value FROM latest WHERE NOT deleted AND key = 'user/000003'")(lambda spark, d: kv.get(keys(spark, d), "user/000003"))
_query("kv_get_deleted", f"WITH {KEYS_SQL}, d AS (SELECT * FROM kv UNION ALL SELECT 'user/000003', NULL, true, 1000000000) SELECT key, value FROM d WHERE key = 'user/000003' QUALIFY row_number() OVER (ORDER BY version DESC) = 1 AND NOT deleted")(
    lambda spark, d: kv.get(keys(spark, d).unionByName(spark.createDataFrame([("user/000003", None, True, 1_000_000_000)], "key string, value string, deleted boolean, version long")), "user/000003")
)
_query("kv_multi_get", f"WITH {KEYS_SQL} SELECT key, value FROM latest WHERE NOT deleted AND key IN ('user/000001', 'user/000004', 'user/000009', 'nobody')")(lambda spark, d: kv.multi_get(keys(spark, d), ["user/000001", "user/000004", "user/000009", "nobody"]))
_query("kv_multi_get_table", f"WITH {KEYS_SQL} SELECT key, value FROM latest WHERE NOT deleted AND key IN (SELECT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)")(
    lambda spark, d: kv.multi_get(keys(spark, d), spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user/"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key")))
)
_query("kv_scan_half_open", f"WITH {KEYS_SQL} SELECT key, value FROM latest WHERE NOT deleted AND key >= 'user/000005' AND key < 'user/000012'")(lambda spark, d: kv.scan(keys(spark, d), "user/000005", "user/000012"))
_query("kv_scan_unbounded", f"WITH {KEYS_SQL} SELECT key, value FROM latest WHERE NOT deleted")(lambda spark, d: kv.scan(keys(spark, d)))
_query("kv_scan_raw_tombstones", f"WITH {KEYS_SQL} SELECT key, value, deleted, version FROM latest WHERE key >= 'user/000002'")(lambda spark, d: kv.scan_raw(keys(spark, d), "user/000002"))
_query("kv_scan_raw_inverted", f"WITH {KEYS_SQL} SELECT key, value, deleted, version FROM latest WHERE false")(lambda spark, d: kv.scan_raw(keys(spark, d), "user/000009", "user/000002"))
_query("kv_lower_bound", f"WITH {KEYS_SQL} SELECT key, value, deleted, version FROM latest WHERE key >= 'user/000005x' ORDER BY key LIMIT 1")(lambda spark, d: kv.lower_bound(keys(spark, d), "user/000005x"))
_query("kv_first_last", f"WITH {KEYS_SQL} SELECT min(key) AS first_key, arg_min(value, key) AS first_value, max(key) AS last_key, arg_max(value, key) AS last_value FROM latest WHERE NOT deleted")(lambda spark, d: kv.first_last(keys(spark, d)))
_query("kv_insert_absent", f"WITH {KEYS_SQL} SELECT key, 'new' AS value FROM (SELECT DISTINCT key FROM kv) k WHERE key NOT IN (SELECT key FROM latest WHERE NOT deleted)")(lambda spark, d: kv.insert_absent(keys(spark, d), keys(spark, d).select("key", F.lit("new").alias("value")).distinct()))


@_query("kv_batch_order", "WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS value, o_orderstatus = 'F' AS deleted, o_orderkey AS i FROM orders) SELECT key, value FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1 AND NOT deleted")
def kv_batch_order(spark, d):
    """An ordered batch: a later operation on a key wins."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    batch = rows.select(F.col("o_orderkey").alias("op_index"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    return kv.live(kv.batch_versions(batch, 100))


@_query("changelog_replay", "WITH c AS (SELECT 'u' || user_id AS key, event_id // 50 AS s, event_id AS r, event_type, props FROM events WHERE event_type <> 'view') SELECT key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, r DESC) = 1")
def changelog_replay(spark, d):
    return changelog.replay(_changes(spark, d))


@_query("changelog_bad_records", "SELECT count(*) AS bad_records FROM events WHERE event_type = 'view'")
def changelog_bad_records(spark, d):
    return changelog.bad_records(_changes(spark, d))


@_query("changelog_prune", "WITH c AS (SELECT 'u' || user_id AS key, event_id // 50 AS s, event_id AS r, event_type, props FROM events WHERE event_type <> 'view' AND event_id // 50 > 10) SELECT key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, r DESC) = 1")
def changelog_prune(spark, d):
    """What a replay finds once the segments up to one are in runs and pruned."""
    return changelog.replay(changelog.prune_through(_changes(spark, d), 10))


def _changes(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "broken").otherwise("put")
    return rows.select(F.expr("event_id div 50").alias("segment_id"), F.col("event_id").alias("record_no"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.col("props").alias("value"))


_query("compact_full", f"WITH {KEYS_SQL} SELECT key, value, deleted, version FROM latest WHERE NOT deleted")(lambda spark, d: compaction.merge_kv(keys(spark, d), bottom=True))
_query("compact_nonbottom", f"WITH {KEYS_SQL} SELECT key, value, deleted, version FROM latest")(lambda spark, d: compaction.merge_kv(keys(spark, d), bottom=False))


@_query("compact_level_select", f"WITH {KEYS_SQL}, r AS (SELECT version % 6 AS id, (version % 6) // 2 AS level, min(key) AS lo, max(key) AS hi FROM kv GROUP BY 1, 2), o AS (SELECT min(lo) AS lo, max(hi) AS hi FROM r WHERE level = 0) SELECT r.id FROM r, o WHERE r.level = 0 OR (r.level = 1 AND r.lo <= o.hi AND r.hi >= o.lo)")
def compact_level_select(spark, d):
    """The manifest's choice of runs for level 0."""
    meta = runs.kv_metadata(keys(spark, d).withColumn("run_id", F.col("version") % 6)).collect()  # a run a row
    held = [compaction.Run(r.run_id, "kv", r.run_id // 2, "x", r.records, 1, r.min_key, r.max_key) for r in sorted(meta)]
    return spark.createDataFrame([(r.id,) for r in compaction.select_runs(held, 0)], "id long")


_query("compaction_report", f"WITH {KEYS_SQL} SELECT count(*) AS input_records, (SELECT count(*) FROM latest WHERE NOT deleted) AS output_records, count(*) - (SELECT count(*) FROM latest WHERE NOT deleted) AS dropped_records FROM kv")(lambda spark, d: compaction.report(keys(spark, d), compaction.merge_kv(keys(spark, d), bottom=True)))
_query("retention_time", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs WHERE ts_nanos >= {NOW - 200 * HOUR}")(lambda spark, d: _select(retention.retain_time(events(spark, d), NOW, 200 * HOUR)))


@_query("retention_size", f"WITH {LOGS_SQL}, s AS (SELECT *, sum(44 + strlen(label_key) + strlen(message)) OVER (ORDER BY ts_nanos DESC, label_key DESC, sequence DESC) AS newer FROM logs) SELECT {_OUT} FROM s WHERE newer <= 40000")
def retention_size(spark, d):
    return _select(retention.retain_size(events(spark, d), 40_000))


@_query("retention_size_ties", f"WITH {LOGS_SQL}, h AS (SELECT ts_nanos // {24 * HOUR} * {24 * HOUR} AS ts_nanos, label_key, sequence, message FROM logs), s AS (SELECT *, sum(44 + strlen(label_key) + strlen(message)) OVER (ORDER BY ts_nanos DESC, label_key DESC, sequence DESC) AS newer FROM h) SELECT {_OUT} FROM s WHERE newer <= 40000")
def retention_size_ties(spark, d):
    """Many entries of the cutoff's nanosecond."""
    return _select(retention.retain_size(events(spark, d).withColumn("ts_nanos", F.expr(f"ts_nanos div {24 * HOUR} * {24 * HOUR}")), 40_000))


_RUNS = "runs AS (SELECT *, sequence % 4 AS run_id FROM logs)"
_query("file_meta", f"WITH {LOGS_SQL}, {_RUNS} SELECT run_id, count(*) AS records, min(ts_nanos) AS min_ts, max(ts_nanos) AS max_ts, min(label_key) AS min_label_key, max(label_key) AS max_label_key FROM runs GROUP BY 1")(lambda spark, d: runs.log_metadata(_runs(spark, d)))
_query("file_meta_kv", f"WITH {KEYS_SQL} SELECT version % 4 AS run_id, count(*) AS records, min(key) AS min_key, max(key) AS max_key FROM kv GROUP BY 1")(lambda spark, d: runs.kv_metadata(keys(spark, d).withColumn("run_id", F.col("version") % 4)))
_query("label_cardinality", f"WITH {LOGS_SQL}, {_RUNS}, l AS (SELECT run_id, 'event_type' AS name, event_type AS value FROM runs UNION ALL SELECT run_id, 'user_id', user_id FROM runs) SELECT run_id, name, count(DISTINCT value) AS n_values FROM l GROUP BY 1, 2")(lambda spark, d: runs.label_cardinality(_runs(spark, d)))


def _runs(spark, d):
    return events(spark, d).withColumn("run_id", F.col("sequence") % 4)


@_query("pruned_query", f"WITH {LOGS_SQL} SELECT {_OUT} FROM logs WHERE ts_nanos BETWEEN {NOW - 200 * HOUR} AND {NOW} AND event_type = 'error'")
def pruned_query(spark, d):
    """The same rows as without skipping: runs are chosen by window and labels, then read."""
    rows = events(spark, d).withColumn("run_id", F.expr(f"ts_nanos div {24 * HOUR}"))
    wanted = runs.runs_to_read(runs.log_metadata(rows), runs.label_tokens(rows), NOW - 200 * HOUR, NOW, {"event_type": "error"})
    return _select(logs.select_logs(rows.join(wanted, "run_id", "left_semi"), NOW - 200 * HOUR, NOW, {"event_type": "error"}))


@_query("verify_sorted", f"WITH {KEYS_SQL}, p AS (SELECT version % 4 AS run_id, key, lag(key) OVER (PARTITION BY version % 4 ORDER BY version) AS before FROM kv) SELECT run_id, count(*) AS records, CAST(count(*) FILTER (before >= key) AS BIGINT) AS out_of_order FROM p GROUP BY 1")
def verify_sorted(spark, d):
    return runs.verify_order(keys(spark, d).withColumn("run_id", F.col("version") % 4), "run_id", ["key"], "version")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return _Q["logs_match_contains"](spark, d)


def queries() -> dict:
    from . import catalog_store  # noqa: F401  adds the queries over stores

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_S)
