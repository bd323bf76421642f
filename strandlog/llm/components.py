"""Connected components with DataFrame operations only."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", owner: Scratch | None = None, at_driver: int = 0) -> DataFrame:
    """Labels each node of an undirected graph with the smallest node it reaches: (node, component).

    Alternates large-star and small-star steps until the edges are a forest of stars. Every step takes
    minima by partial aggregation and joins them back on the node, so that a hub costs one row a task
    and AQE can split its side of the join. Each round is a table in the shared folder. Null ends and
    loops are left out; a node of no edge has no row. owner gets the last table, to drop it in time.
    A graph of up to at_driver different edges (two longs each) is labelled by the driver, whole, without rounds of jobs.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pair = (F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    stars = scratch.table("0", edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(*pair).distinct())
    seen = _state(stars)
    if not seen[0]:
        scratch.drop("0")
        return spark.createDataFrame([], stars.schema).select(F.col("a").alias("node"), F.col("b").alias("component"))
    if seen[0] <= at_driver:
        edges = stars.toArrow()
        nodes, label = labels(edges.column("a").to_numpy(), edges.column("b").to_numpy())
        table = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(label, pa.int64())})
        out = scratch.table("labels", spark.createDataFrame(table).coalesce(1))
        scratch.drop("0")
        if owner is not None:
            owner.paths[f"components-{uuid.uuid4().hex[:8]}"] = scratch.paths["labels"]
        return out
    for step in range(1, 200):
        low = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stars.join(low, stars.b == low.u).select("a", F.col("m").alias("b")).where("a != b").distinct()
        large = scratch.table(f"{step}-large", large)
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.u).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        small = scratch.table(str(step), small)
        scratch.drop(str(step - 1), f"{step}-large")
        now = _state(small)
        stars = small
        if now == seen:
            if owner is not None:
                owner.paths[f"components-{uuid.uuid4().hex[:8]}"] = scratch.paths[str(step)]
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError("the components did not settle")


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nodes of these edges, the smallest node that each one reaches): roots hook to smaller ones, then paths are halved."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != (up := root[root])).any():
            root = up


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x
