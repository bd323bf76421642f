"""Shortest-pack-first packing over the length histogram."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, slices, text_bytes

END_ID = 1
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs counted lengths, longest first, each into the shortest pack that has room: [(lengths of a pack, count)].

    Equal packs are one pattern with a count, so the work depends on the number of lengths (size at most), not of
    documents. A length that fits no pack opens new ones, which its own copies fill first, being the shortest.
    """
    room: dict[int, list[list]] = defaultdict(list)  # space left -> patterns [lengths, count]
    full = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            best = max((r for r, p in room.items() if p), default=0)
            if best < length:
                fit = size // length
                many, rest = divmod(left, fit)
                for lengths, count in (((length,) * fit, many), ((length,) * rest, 1 if rest else 0)):
                    if count:
                        space = size - sum(lengths)
                        (room[space] if space else full).append([lengths, count])
                left = 0
                continue
            pattern = room[best][-1]
            used = min(left, pattern[1])
            pattern[1] -= used
            if not pattern[1]:
                room[best].pop()
            new = [pattern[0] + (length,), used]
            (room[best - length] if best > length else full).append(new)
            left -= used
    return [(tuple(p), c) for p, c in full + [x for ps in room.values() for x in ps]]


def slot_table(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, what its copies by rank get: (first rank, first sequence, copies in a pack, their offsets).

    Its entries are at most as many as the patterns' different lengths.
    """
    entries: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, count in patterns:
        at, offsets = 0, defaultdict(list)
        for x in lengths:
            offsets[x].append(at)
            at += x
        for x, places in offsets.items():
            entries[x].append((ranks[x], sequence, places))
            ranks[x] += count * len(places)
        sequence += count
    table = {}
    for x, rows in entries.items():
        copies = np.array([len(p) for _, _, p in rows], np.int64)
        table[x] = np.array([r for r, _, _ in rows], np.int64), np.array([s for _, s, _ in rows], np.int64), copies, np.cumsum(copies) - copies, np.array([o for _, _, p in rows for o in p], np.int64)
    return table


def _tokenize(path: str, size: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from .tokens import WordIds

        words, part, seen = WordIds(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, offsets = words.encode(*text_bytes(piece.column(1)))
                tokens = np.diff(offsets) + 1
                all_ids = np.insert(ids, offsets[1:], END_ID).astype("<u4")
                begin = np.cumsum(tokens) - tokens
                count = -(-tokens // size)
                doc = np.repeat(np.arange(len(tokens)), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * size
                length = np.minimum(size, tokens[doc] - start)
                at = (begin[doc] + start) * 4
                data = memoryview(all_ids.tobytes())
                crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(order)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(tokens[doc], pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank, pa.int64())], names=[f.split()[0] for f in _PIECES.split(", ")])

    return run


def _place(table):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                first, base, copies, places, offsets = table.value[int(x)]
                own = length == x
                entry = np.searchsorted(first, rank[own], "right") - 1
                turn = rank[own] - first[entry]
                sequence[own] = base[entry] + turn // copies[entry]
                offset[own] = offsets[places[entry] + turn % copies[entry]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(length.astype(np.int64)), batch.column("ids_crc32"), batch.column("doc_tokens"), pa.array(sequence), pa.array(offset)], names=[f.split()[0] for f in _PLACED.split(", ")])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """Packs documents into sequences of at most size tokens: a row a piece, (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids under the tokenizer file plus END_ID, cut into pieces of size and a remainder. Only the
    histogram of lengths (size entries at most) comes to the driver; the patterns that shortest_pack_first makes of
    it are joined back by the rank of a piece among those of its length. Ranks are counted inside each task and
    moved by the tasks before it, so no length is gathered in one place.

    A null text is empty: its one token is END_ID. Null or repeated ids are documents like others. Other columns are
    ignored; an empty table gives no rows. tokenizer is a path that executors can open.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.table("pieces", rows.mapInArrow(_tokenize(tokenizer, size), _PIECES))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = scratch.table("moved", counts.select(F.col("part").alias("p"), F.col("length").alias("l"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    histogram = {r.l: r.n for r in moved.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    # merged, not broadcast: there are up to `size` counts for each task of the first pass
    table = spark.sparkContext.broadcast(slot_table(shortest_pack_first(histogram, size), size))
    ranked = pieces.join(moved.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(table), _PLACED)
