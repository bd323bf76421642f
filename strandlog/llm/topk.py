"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

_BLOCK = "dim int, slots int, slot int, side int, n int, ids binary, asks binary, vectors binary, distances binary"
_HITS = "query_id long, ask long, vec_id long, score long"
#: Norms up to which a kind of vector goes: products of the first kind are exact in doubles, those up to _LONG in 64-bit integers.
_KINDS = np.array([2.0**26, 2.0**30])
_DOUBLE, _LONG = 2.0**52, 2.0**61
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Components that a block, and the data blocks of a slot, hold at most.
_BLOCK_FLOATS, _SLOT_FLOATS = 1 << 18, 1 << 23


def floored(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in doubles, infinite where that passes them."""
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python integers, without bound."""
    out = [int(b) if np.isfinite(b) else int(Fraction(a) * Fraction(scale) // 1) for a, b in zip(x.ravel().tolist(), floored(x, scale).ravel().tolist())]
    return np.array([*out, None], object)[:-1].reshape(x.shape)


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(-1))


def _products(block: _Data, part: np.ndarray, q: np.ndarray, floor_q: np.ndarray, bound: float, scale: float) -> np.ndarray:
    """Integer products of some rows of a block with q as longs; one beyond a long is the nearest long. bound: of their absolute values."""
    if bound < _DOUBLE:
        return (block.floors[part] @ floor_q).astype(np.int64)
    if bound < _LONG:  # wraps modulo 2**64 on the way, but not in the end
        return block.floors[part].astype(np.int64) @ floor_q.astype(np.int64)
    own = whole(q, scale).tolist()
    return np.array([min(_MOST, max(_LEAST, sum(a * b for a, b in zip(row, own)))) for row in whole(block.x[part], scale).tolist()], np.int64)


def _blocks(scale: float, size: int, pivots: dict[int, np.ndarray], side: int):
    """Packs rows (id, v, slots) into blocks of one length and kind, with the distances to the pivots of that length."""
    names = [f.strip().split()[0] for f in _BLOCK.split(",")]
    types = [*[pa.int32()] * 5, *[pa.binary()] * 4]

    def pack(dim: int, slots: int, ids: list[int], asks: list[int], rows: list[np.ndarray]):
        x = np.stack(rows) if dim else np.zeros((len(rows), 0))
        d = np.zeros((len(rows), 0))
        if dim in pivots:
            with np.errstate(all="ignore"):
                d = np.stack([_norms(floored(x, scale) - p) for p in pivots[dim]], 1)
        slot = ((ids[0] ^ asks[0]) * 0x9E3779B97F4A7C15 >> 17) % slots
        row = dim, slots, slot, side, len(rows), *(np.asarray(v, t).tobytes() for v, t in ((ids, "<i8"), (asks, "<i8"), (x, "<f8"), (d, "<f8")))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    def run(batches):
        held, inside, seen = {}, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, slots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            column = batch.column(1).cast(pa.list_(pa.float64()))
            offsets = np.asarray(column.offsets, np.int64)
            x = column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.zeros(0)
            for i in range(len(ids)):
                own = x[offsets[i] : offsets[i + 1]].copy()
                key = len(own), int(np.searchsorted(_KINDS, _norms(floored(own, scale)), "right"))
                rows = held.setdefault(key, (slots[i], [], [], []))
                for part, value in zip(rows[1:], (ids[i], seen, own)):
                    part.append(value)
                seen, inside = seen + 1, inside + len(own) + 8
                if len(rows[1]) >= min(size, max(1, _BLOCK_FLOATS // max(1, len(own)))):
                    inside -= len(rows[1]) * (len(own) + 8)
                    yield pack(key[0], *held.pop(key))
                elif inside > 8 * _BLOCK_FLOATS:  # many lengths: what is held goes as it is
                    for (dim, _), rest in held.items():
                        yield pack(dim, *rest)
                    held, inside = {}, 0
        for (dim, _), rows in held.items():
            yield pack(dim, *rows)

    return run


class _Data:
    """A data block with what its bounds need: norms, and ranges of the norms and of the distances to each pivot."""

    def __init__(self, ids, vectors, distances, scale):
        self.ids, self.x, self.d = ids, vectors, distances
        self.floors = floored(vectors, scale)
        self.norm = _norms(self.floors)
        self.low, self.high = (distances.min(0), distances.max(0)) if distances.shape[1] else (np.zeros(0), np.zeros(0))
        self.most = float(self.norm.max(initial=0))


def _above(near: np.ndarray, q: np.ndarray, x) -> np.ndarray:
    """Upper bounds of products from lower bounds of distances and the norms; the slack covers the rounding of all of them."""
    with np.errstate(all="ignore"):
        q2, x2 = q * q, x * x
        upper = (q2 + x2 - near * near) / 2 + 1 + 1e-9 * (q2 + x2)
    return np.where(np.isfinite(upper), upper, np.inf)


def _search(k: int, scale: float):
    """Top k of each query block against the data blocks of its slot, which come before it in the partition's order.

    Data blocks are tried in the order of their best bound, and inside a block the candidates in the order of theirs,
    until the k-th score beats what is left; a block whose bound no query's k-th score leaves open is never opened.
    """

    def results(data: list[_Data], ids, asks, q, qd):
        floors = floored(q, scale)
        norm = _norms(floors)
        scores, found = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
        bounds = []
        for block in data:
            with np.errstate(all="ignore"):
                gap = np.nan_to_num(np.maximum(qd - block.high, block.low - qd).max(1, initial=0), nan=0, posinf=0)
            bounds.append(_above(gap, norm, block.most))
        for b in sorted(range(len(data)), key=lambda b: -float(np.minimum(bounds[b], 1e300).sum())):
            block = data[b]
            for i in range(len(ids)):
                full = len(scores[i]) == k
                if full and bounds[b][i] < float(scores[i][-1]):
                    continue
                with np.errstate(all="ignore"):
                    gap = np.nan_to_num(np.abs(block.d - qd[i]).max(1, initial=0), nan=0, posinf=0)
                upper = _above(gap, norm[i], block.norm)
                near = np.flatnonzero(upper >= float(scores[i][-1])) if full else np.arange(len(upper))
                near = near[np.argsort(-upper[near], kind="stable")]
                for at in range(0, len(near), 1024):
                    part = near[at : at + 1024]
                    if len(scores[i]) == k and upper[part[0]] < float(scores[i][-1]):
                        break
                    with np.errstate(over="ignore"):
                        limit = float(norm[i] * block.norm[part].max(initial=0))
                    own = _products(block, part, q[i], floors[i], limit, scale)
                    keep = block.ids[part] != ids[i]
                    if len(scores[i]) == k:
                        keep &= own >= scores[i][-1]
                    if keep.any():
                        s, v = np.concatenate([scores[i], own[keep]]), np.concatenate([found[i], block.ids[part][keep]])
                        order = np.lexsort((v, ~s))[:k]
                        scores[i], found[i] = s[order], v[order]
        n = [len(s) for s in scores]
        columns = np.repeat(ids, n), np.repeat(asks, n), np.concatenate(found), np.concatenate(scores)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "ask", "vec_id", "score"])

    def run(batches):
        key, data = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {f: batch.column(j)[r].as_py() for j, f in enumerate(batch.schema.names)}
                if (row["dim"], row["slot"]) != key:
                    key, data = (row["dim"], row["slot"]), []
                ids, asks = (np.frombuffer(row[c], "<i8") for c in ("ids", "asks"))
                x, d = (np.frombuffer(row[c], "<f8").reshape(row["n"], -1) for c in ("vectors", "distances"))
                if not row["side"]:
                    data.append(_Data(ids, x, d, scale))
                elif data:
                    yield results(data, ids, asks, x, d)

    return run


def _pivots(rows: DataFrame, sizes: DataFrame, n_pivots: int, scale: float) -> dict[int, np.ndarray]:
    """n_pivots vectors of each length, by a hash of their ids, in one job. Lengths that hold the most come first; all
    pivots together hold 2**20 components at most, and a length without any is bounded by its norms alone."""
    room, dims = 1 << 20, []
    for r in sizes.where("dim > 0").orderBy(F.desc("floats"), "dim").limit(256).collect():
        if 4 * n_pivots * r.dim <= room:
            room -= 4 * n_pivots * r.dim
            dims.append(r.dim)
    if not dims:
        return {}
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.withColumn("dim", F.size("v")).where(F.col("dim").isin(dims)).withColumn("nth", nth).where(F.col("nth") <= 4 * n_pivots).select("dim", "nth", "v").collect()
    out: dict[int, dict] = {d: {} for d in dims}
    for r in sorted(chosen, key=lambda r: (r.dim, r.nth)):
        m = floored(np.array(r.v, float), scale)
        if len(out[r.dim]) < n_pivots and np.isfinite(_norms(m)):
            out[r.dim].setdefault(m.tobytes(), m)
    return {d: np.stack(list(p.values())) for d, p in out.items() if p}


def exact_top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, n_pivots: int = 12, block: int = 2048, query_block: int = 512) -> DataFrame:
    """The k highest integer inner products of each query among all rows of another id: (query_id, ask, rank, vec_id, score).

    Components become floor(scale * x). Distances from every vector to n_pivots fixed pivots are worked out once;
    |d(q, p) - d(x, p)| bounds the distance of q and x from below and so their product from above, for single vectors and
    for whole blocks. Candidates are evaluated in the order of that bound until the k-th score beats what is left, so
    the result is exact. Data blocks are dealt to slots of 64 MB at most, query blocks go to every slot of their length;
    a task holds one slot's data blocks and streams the queries past them. Only pivots come to the driver.

    Products are exact whole numbers at any size: in doubles while norms allow, then in 64-bit integers, then in Python's.
    One beyond a long counts as the nearest long, also in the ranking. Null ids, and vectors that are null or hold null
    or non-finite components, take no part. Vectors of different lengths, however many lengths there are, are not
    compared (an empty vector has product 0 with its like). Ties go to the smaller id. Rows that repeat an id are
    separate candidates and separate queries, which ask tells apart. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")).where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    floats = F.col("n") * F.greatest(F.col("dim"), F.lit(1))
    slots = F.greatest(F.ceil(floats / _SLOT_FLOATS), F.least(F.lit(64), F.ceil(floats / (64 * block)))).cast("int")
    sizes = scratch.table("sizes", rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).select("dim", floats.alias("floats"), slots.alias("slots")))
    pivots = _pivots(rows, sizes, n_pivots, scale)
    placed = rows.join(sizes, F.size("v") == F.col("dim"))
    data = placed.select("id", "v", "slots").mapInArrow(_blocks(scale, block, pivots, 0), _BLOCK)
    asked = scratch.table("queries", placed.where("is_query").select("id", "v", "slots").mapInArrow(_blocks(scale, query_block, pivots, 1), _BLOCK))
    everywhere = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(*data.columns)
    hits = data.unionByName(everywhere).repartition("dim", "slot").sortWithinPartitions("dim", "slot", "side").mapInArrow(_search(k, scale), _HITS)
    rank = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "ask", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
