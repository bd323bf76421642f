"""Removal of lines that spread over many sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def line_key(line: Column) -> Column:
    """What lines are compared by: the line without spaces at its ends, as two 64-bit hashes; null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def text_key(text: Column) -> Column:
    """What copies are told by: a hash of the lines that aren't blank, without spaces at their ends, in order."""
    return F.xxhash64(F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n"))


def spread_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", least_sites: int = 10, least_texts: int = 1, log2_registers: int = 12, band: float = 0.25) -> DataFrame:
    """Keys of the lines that stand on least_sites different sites or more, and in least_texts different texts: (a, b).

    HyperLogLog sketches of the sites (and texts) merge per line by aggregation, on the map side first, so a line that is
    everywhere costs one sketch a task. Estimates of at least (1 + band) times the least number are taken, those under
    (1 - band) are not (the error is 1.6 %, less for few); lines between get exact distinct counts.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    asked = {"site": (F.col(site_col).cast("string"), least_sites)} | ({"copy": (text_key(F.col(text_col)), least_texts)} if least_texts > 1 else {})
    keys = F.array_distinct(F.transform(F.split(F.col(text_col), "\n", -1), line_key))
    lines = docs.where(F.col(site_col).isNotNull() & F.col(text_col).isNotNull()).select(*[c.alias(n) for n, (c, _) in asked.items()], keys.alias("ks")).select(*asked, F.explode("ks").alias("k")).where("k is not null").select("k.a", "k.b", *asked)
    sketched = lines.groupBy("a", "b").agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(n, log2_registers)).alias(n) for n in asked])
    all_of = lambda share: F.lit(True) if not asked else reduce(lambda x, y: x & y, [F.col(n) >= (1 + share) * least for n, (_, least) in asked.items()])
    near = scratch.table("near", sketched.where(all_of(-band)).select("a", "b", all_of(band).alias("sure")))
    unsure = near.where("not sure").select(F.col("a").alias("ua"), F.col("b").alias("ub"))
    some = lines.join(unsure, (F.col("a") == F.col("ua")) & (F.col("b") == F.col("ub")), "left_semi")
    counted = [some.select("a", "b", n).distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b") for n, (_, least) in asked.items()]
    exact = reduce(lambda x, y: x.join(y, ["a", "b"], "left_semi"), counted)
    out = scratch.table("spread", near.where("sure").select("a", "b").unionByName(exact))
    scratch.drop("near")
    return out


def remove_spread_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 10, least_texts: int = 1, out_col: str = "kept_text", removed_col: str = "removed_lines") -> DataFrame:
    """Appends the text without its boilerplate, and how many lines went.

    Boilerplate is every line (spaces at its ends apart) that stands on least_sites sites or more; it goes whatever its
    share of a document. With least_texts such a line must stand in as many different texts too: then a page that is
    copied whole over many sites isn't boilerplate by itself, and the near-duplicate stage can keep one of its copies.

    Each document's lines are cut once; the places of its spread lines come back to it by a join on its id and a hash
    of its text, so documents that repeat an id, or have none, still each lose their own lines only, and the work
    follows a text's lines however long it is. Null texts stay null with no line removed, null sites count for no
    line. Columns named like a result are replaced, others stay, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop(out_col, removed_col)
    found = spread_lines(docs, text_col=text_col, site_col=site_col, least_sites=least_sites, least_texts=least_texts).select(F.col("a").alias("sa"), F.col("b").alias("sb"))
    parts = F.split(F.col(text_col), "\n", -1)
    cut = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.posexplode(F.transform(parts, line_key)).alias("at", "k")).where("k is not null")
    held = cut.join(found, (F.col("k.a") == F.col("sa")) & (F.col("k.b") == F.col("sb"))).groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_set("at")).alias("__at"))
    # a merge join at every size: what it moves follows the input, and what it needs doesn't grow with the spread lines
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__h"))
    joined = docs.join(scratch.table("held", held).hint("merge"), same, "left").withColumn("__lines", F.when(F.col("__at").isNotNull(), parts))
    marked = joined.withColumn("__ends", F.concat(F.array(F.lit(-1)), "__at", F.array(F.size("__lines"))))
    between = F.transform(F.sequence(F.lit(0), F.size("__at")), lambda i: F.slice("__lines", F.get("__ends", i) + 2, F.get("__ends", i + 1) - F.get("__ends", i) - 1))
    kept = F.when(F.col("__at").isNotNull(), F.array_join(F.flatten(between), "\n")).otherwise(F.col(text_col))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], kept.alias(out_col), F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias(removed_col))
