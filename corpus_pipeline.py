"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.decontaminate import contamination
from strandlog.llm.jaccard import jaccard_components
from strandlog.llm.langid import identify, train
from strandlog.llm.lines import remove_spread_lines
from strandlog.llm.packing import pack_documents
from strandlog.llm.shared import Scratch, told

#: SQL can't express the language model; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: no letter, or less sure than its calibrated score."""
    model = train(docs, F.lit(True))
    return identify(docs, model).where("not lang_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts, whatever their share; n_chars follows the text.

    A line must stand in ten different texts too, so that a page copied whole over ten sites is left to the next stage.
    """
    out = remove_spread_lines(docs, least_texts=10)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("removed_lines") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose five-word shingle sets link at 0.8; documents without words stay.

    Rows are told apart by a number of their own, so of rows that repeat an id, and of those without one (they come
    last), exactly one of a group stays too.
    """
    scratch = Scratch(spark, "pipeline")
    rows = scratch.table("rows", docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = scratch.table("groups", jaccard_components(rows, id_col="__row", shingle=5, percent=80).where("n_shingles > 0").select("id", "component"))
    ids = rows.select("__row", "doc_id")
    kept = groups.join(ids, F.col("id") == F.col("__row")).groupBy("component").agg(F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("kept"))
    extra = scratch.table("extra", groups.join(kept, F.col("id") == F.col("kept"), "left_anti").select(F.col("id").alias("__extra")))
    return rows.join(told(extra), F.col("__row") == F.col("__extra"), "left_anti").drop("__row")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).where("size(hits) = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row a piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result a Parquet table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
