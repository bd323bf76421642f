"""Per-run metadata, and what it lets a read skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kv_metadata(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Records, smallest and largest key of each run."""
    return runs.groupBy(run).agg(F.count("*").alias("records"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def log_metadata(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Records, time range and label-key range of each run."""
    return runs.groupBy(run).agg(F.count("*").alias("records"), F.min("ts_nanos").alias("min_ts"), F.max("ts_nanos").alias("max_ts"), F.min("label_key").alias("min_label_key"), F.max("label_key").alias("max_label_key"))


def label_tokens(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Each label's different values in each run."""
    return runs.select(run, F.explode(F.map_entries("labels")).alias("l")).select(run, F.col("l.key").alias("name"), F.col("l.value").alias("value")).distinct()


def label_cardinality(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """How many different values each label has in each run, exactly."""
    return label_tokens(runs, run).groupBy(run, "name").agg(F.count("*").alias("n_values"))


def runs_to_read(metadata: DataFrame, tokens: DataFrame, start: int, end: int, labels: dict[str, str], run: str = "run_id") -> DataFrame:
    """Runs that overlap a window and may hold the labels. Wanted empty values match missing labels, so they skip nothing."""
    out = metadata.where((F.col("max_ts") >= start) & (F.col("min_ts") <= end)).select(run)
    for name, value in sorted(labels.items()):
        if value != "":
            out = out.join(tokens.where((F.col("name") == name) & (F.col("value") == value)).select(run), run, "left_semi")
    return out


def verify_order(runs: DataFrame, run: str, keys: list[str], place: str) -> DataFrame:
    """For each run, its records and how many don't come strictly after the one before them, by its own order of rows."""
    from pyspark.sql import Window

    before = Window.partitionBy(run).orderBy(place)
    key = F.struct(*keys)
    return runs.withColumn("__before", F.lag(key).over(before)).groupBy(run).agg(F.count("*").alias("records"), F.sum(F.when(F.col("__before") >= key, 1).otherwise(0)).alias("out_of_order"))


def stats_by_level(files: DataFrame) -> DataFrame:
    """Files, records and bytes of each level."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
