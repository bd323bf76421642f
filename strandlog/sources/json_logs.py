"""JSON batches of log entries: an array, or an object with entries; strict as a whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import check_labels, label_key, labels_valid
from ..functions.times import parse_rfc3339, rfc3339_nanos
from ..model import InvalidEntry, InvalidLabel, MAX_BATCH

FIELDS = {"timestamp", "labels", "message", "sequence"}
_TYPES = "timestamp variant, labels variant, message variant, sequence variant"


def parse_batch(text: str, now_nanos: int, most: int = MAX_BATCH) -> list[tuple[int, dict[str, str], str, int]]:
    """A request body as entries for Store.write_logs; the first bad one refuses all."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise InvalidEntry(f"not JSON: {e}") from e
    if isinstance(raw, dict):
        if set(raw) != {"entries"}:
            raise InvalidEntry("a batch object holds entries and nothing else")
        raw = raw["entries"]
    if not isinstance(raw, list) or not 1 <= len(raw) <= most:
        raise InvalidEntry(f"a batch holds 1 to {most} entries")
    return [parse_entry(x, now_nanos) for x in raw]


def parse_entry(raw, now_nanos: int) -> tuple[int, dict[str, str], str, int]:
    if not isinstance(raw, dict) or set(raw) - FIELDS:
        raise InvalidEntry("an entry is an object with timestamp, labels, message and sequence at most")
    message = raw.get("message")
    labels = {} if raw.get("labels") is None else raw["labels"]
    sequence = 0 if raw.get("sequence") is None else raw["sequence"]
    if not isinstance(message, str):
        raise InvalidEntry("an entry needs a message")
    if not isinstance(labels, dict) or not all(isinstance(v, str) for v in labels.values()):
        raise InvalidEntry("labels are an object of strings")
    if not isinstance(sequence, int) or isinstance(sequence, bool) or not 0 <= sequence < 1 << 63:
        raise InvalidEntry("a sequence is a whole number below 2**63")
    try:
        ts = parse_rfc3339(raw["timestamp"]) if raw.get("timestamp") is not None else now_nanos
        return ts, check_labels(labels.items()), message, sequence
    except (ValueError, TypeError, InvalidLabel) as e:
        raise InvalidEntry(str(e)) from e


def entries_from_lines(lines: DataFrame, now_nanos: int, column: str = "value") -> DataFrame:
    """One JSON entry a line as log rows with an error column, in the cluster; null error means a valid entry.

    As strict as parse_entry: each field's own JSON type is looked at before it is read, so that neither a number nor an
    object becomes a text, nor a fraction a sequence.
    """
    parsed = lines.select(F.col(column).alias("line"), F.from_json(column, _TYPES, {"mode": "PERMISSIVE"}).alias("e"), F.json_object_keys(column).alias("keys"))
    kind = lambda field: F.coalesce(F.schema_of_variant(F.col(f"e.{field}")), F.lit("VOID"))  # noqa: E731  VOID: JSON's null, or not there
    get = lambda field, path, type_: F.try_variant_get(F.col(f"e.{field}"), path, type_)
    inside = get("labels", "$", "map<string,variant>")
    texts = F.coalesce(F.forall(F.map_values(inside), lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "STRING"), F.lit(True))
    labels = F.coalesce(F.when(texts, get("labels", "$", "map<string,string>")), F.create_map().cast("map<string,string>"))
    message, given = get("message", "$", "string"), get("timestamp", "$", "string")
    ts = F.when(kind("timestamp") == "VOID", F.lit(now_nanos)).otherwise(rfc3339_nanos(given))
    sequence = F.coalesce(get("sequence", "$", "long"), F.lit(0))
    error = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, sorted(FIELDS))))) > 0, "unknown field")
        .when(kind("message") != "STRING", "no message")
        .when(~kind("timestamp").isin("STRING", "VOID") | ts.isNull(), "bad timestamp")
        .when(~(kind("labels").startswith("OBJECT") | (kind("labels") == "VOID")) | ~texts | ~labels_valid(labels), "bad label")
        .when(~kind("sequence").isin("BIGINT", "VOID") | (sequence < 0), "bad sequence")
    )
    return parsed.select(ts.alias("ts_nanos"), labels.alias("labels"), label_key(labels).alias("label_key"), sequence.alias("sequence"), message.alias("message"), error.alias("error"))


def read_batch_file(spark: SparkSession, path: str, now_nanos: int) -> DataFrame:
    """Files of one batch each, or of one entry a line, as validated log rows; one bad entry refuses all."""
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json(F.get_json_object("value", "$.entries"), "array<string>"))
    entries = whole.select(F.explode(F.coalesce(wrapped, F.split(F.rtrim("value"), "\n"))).alias("value"))
    rows = entries_from_lines(entries, now_nanos)
    return rows.withColumn("message", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("message"))).drop("error")
