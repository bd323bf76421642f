"""Removal of repeated byte strings: prefix doubling over the places that an exact filter leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, eights, mixed, sequence_hashes, slices, span_hashes, text_bytes

_RUN = "key long, span long, doc long, sub long, start long, windows int, at int, done boolean"
_PAIR = "a long, b long, doc long, sub long, at long"
_RANKED = "part int, rank long, doc long, sub long, at long, again boolean, edge int, a long, b long"
_GRAM_PLACES = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ** 3) % (1 << 64) | 1 for k in range(64)], np.uint64)


#: Bytes of text that are sifted at a time: what repeats inside a slice leaves before the shuffle.
_SLICE = 2 << 20


def _names(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(",")]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_names(schema))


def gram_hashes(at8: np.ndarray, n: int, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each place. It only chooses and groups places, so a collision costs work, not rightness."""
    size = max(0, n - gram + 1)
    h = np.zeros(size, np.uint64)
    for k, at in enumerate(sorted({*range(0, gram - 7, 8), gram - 8})):
        h += at8[at : at + size] * _GRAM_PLACES[k]
    return mixed(h)


def anchors(at8: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """Runs of windows of `size` bytes by the gram that stands for them: (text, first window, windows, gram's place, gram hash).

    A window's gram is the least by hash (the last of equals) of the `gram`-byte strings in it, so that equal windows
    have their gram at the same place, and windows that follow each other share it: about 2 / (size - gram + 2) grams a byte.
    """
    n = np.diff(offsets)
    if not (n >= size).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    width = size - gram + 1
    h = gram_hashes(at8, int(offsets[-1]), gram)
    # the least of each run of `width` grams, as (hash, place from the end): doubling of the run's length
    low, at, have = h.copy(), np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = low[: len(low) - step], low[step:]
        later = b <= a
        at = np.where(later, at[step:], at[: len(at) - step])
        low = np.where(later, b, a)
        have += step
    many = np.maximum(0, n - size + 1)
    text = np.repeat(np.arange(len(n)), many)
    window = offsets[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    place = at[window]
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], window[first], np.diff(np.append(first, len(text))), place[first], h[place[first]]


def _run_rows(size: int, doc, sub, key, span, start, count, at) -> pa.RecordBatch:
    """Rows of a slice's runs; those that repeat an earlier one of the slice leave as stretches, neighbours joined."""
    order = np.lexsort((start, sub, doc, span, key))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = (key[order][1:] == key[order][:-1]) & (span[order][1:] == span[order][:-1])
    done = np.zeros(len(order), bool)
    done[order] = repeat
    rest, gone = np.flatnonzero(~done), np.flatnonzero(done)
    head = np.ones(len(gone), bool)
    head[1:] = (gone[1:] != gone[:-1] + 1) | (doc[gone[1:]] != doc[gone[:-1]]) | (sub[gone[1:]] != sub[gone[:-1]]) | (start[gone[1:]] > start[gone[:-1]] + count[gone[:-1]] + size - 1)
    first = np.flatnonzero(head)
    lead, last = gone[first], gone[np.append(first[1:], len(gone)) - 1] if len(gone) else gone
    stop = start[last] + count[last]
    pick = np.concatenate([rest, lead])
    windows = np.concatenate([count[rest], stop - start[lead]]).astype(np.int32)
    return _batch(_RUN, key[pick].view(np.int64), span[pick].view(np.int64), doc[pick], sub[pick], start[pick], windows, at[pick].astype(np.int32), np.arange(len(pick)) >= len(rest))


def _runs(size: int, gram: int, stretch: int):
    """Runs of windows, by the gram that stands for them and a hash of all their bytes; a text of more than stretch windows a part at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                doc, sub = part.column(0).to_numpy(), part.column(1).to_numpy()
                raw, offsets = text_bytes(part.column(2))
                whole = len(raw)
                for low in range(0, whole, stretch) if part.num_rows == 1 else (0,):  # a longer slice than a stretch is one text
                    own = raw[low : low + stretch + size - 1] if part.num_rows == 1 else raw
                    edges = np.array([0, len(own)]) if part.num_rows == 1 else offsets
                    at8 = np.ascontiguousarray(eights(own))
                    text, window, count, place, key = anchors(at8, edges, size, gram)
                    if len(text):
                        span = span_hashes(at8, window, window + count + size - 1)
                        yield _run_rows(size, doc[text], sub[text], key, span, window - edges[text] + low, count, place - window)

    return run


def _listed(part: pa.RecordBatch, *fields: int) -> list[np.ndarray]:
    """The text numbers and fields of the runs that stand in a slice's column 3, by place."""
    lists = part.column(3)
    flat = lists.flatten()
    values = [flat.field(k).to_numpy().astype(np.int64) for k in fields]
    text = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
    order = np.lexsort((values[0], text))
    return [text[order], *[v[order] for v in values]]


def _cores(size: int, gram: int, few: int):
    """Open runs cut into runs of `few` windows at most, by the bytes that all of these share (size - few + 1 at least).

    Cuts stand at fixed distances from the gram, so equal windows of different runs come under the same bytes again.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                doc, sub = part.column(0).to_numpy(), part.column(1).to_numpy()
                raw, offsets = text_bytes(part.column(2))
                at8 = eights(raw)
                text, start, many, at = _listed(part, 0, 1, 2)
                if not len(text):
                    continue
                far, near = at, at - many + 1  # distances from a window's start to the gram
                cuts = far // few - near // few + 1
                own = np.repeat(np.arange(len(text)), cuts)
                k = (far // few)[own] - np.arange(len(own)) + np.repeat(np.cumsum(cuts) - cuts, cuts)  # the farthest from the gram begins first
                low, high = k * few, np.minimum(k * few + few - 1, size - gram)
                place = (start + at + offsets[text])[own]
                first, last = place - np.minimum(high, far[own]), place - np.maximum(low, near[own])
                key = span_hashes(at8, place - low, place - high + size, 1) + k.astype(np.uint64)
                span = span_hashes(at8, first, last + size)
                text = text[own]
                yield _run_rows(size, doc[text], sub[text], key, span, first - offsets[text], last - first + 1, place - first)

    return run


def steps(size: int) -> tuple[int, int]:
    """Offsets of the two doubling rounds: names of `size - sum(offsets)` bytes become ranks of twice that, then of size."""
    half = -(-size // 2)
    return half - -(-half // 2), size - half


def _first_pairs(size: int):
    """For each place that an open window needs, the names of the bytes there and one offset further on, as one fingerprint (b is 0).

    A name is a hash of a quarter of the size, the ranks that doubling begins with. at is twice the place, plus one if
    an open window begins there; places without that only serve as the second half of a window.
    """
    one, two = steps(size)
    base = size - one - two

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                raw, offsets = text_bytes(part.column(2))
                at8 = eights(raw)
                text, start, many = _listed(part, 0, 1)
                start = start + offsets[text]
                stop = start + many
                # both halves of the windows, joined where they overlap; windows of different runs never do
                low, high, of = np.concatenate([start, start + two]), np.concatenate([stop, stop + two]), np.concatenate([text, text])
                order = np.lexsort((low, of))
                low, high, of = low[order], high[order], of[order]
                reach = np.maximum.accumulate(high) if len(high) else high
                new = np.append(True, (low[1:] > reach[:-1]) | (of[1:] != of[:-1])) if len(low) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                low, high, of = low[first], reach[np.append(first[1:], len(reach)) - 1], of[first]
                for a, b in _portions(low, high):
                    size_ = high[a:b] - low[a:b]
                    own = np.repeat(np.arange(b - a), size_)
                    place = np.arange(len(own)) + (low[a:b] - (np.cumsum(size_) - size_))[own]
                    wide = size_ + one  # names of the places and, behind each piece, of the offset that follows it
                    every = np.arange(int(wide.sum())) + np.repeat(low[a:b] - (np.cumsum(wide) - wide), wide)
                    names = span_hashes(at8, every, every + base)
                    here = np.arange(len(place)) + own * one
                    pair = sequence_hashes(np.stack([names[here], names[here + one]], 1).ravel(), 2 * np.arange(len(here)), 2)
                    slot = np.searchsorted(start, place, "right") - 1
                    wanted = (slot >= 0) & (place < stop[np.maximum(slot, 0)])
                    doc = of[a:b][own]
                    yield _batch(_PAIR, pair.view(np.int64), np.zeros(len(pair), np.int64), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), (place - offsets[doc]) * 2 + wanted)

    return run


def _portions(low: np.ndarray, high: np.ndarray, most: int = 1 << 20):
    """Cuts a list of pieces [low, high) into portions of about `most` places."""
    ends, at = np.cumsum(high - low), 0
    while at < len(low):
        b = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, b
        at = b


def _ranks(batches):
    """Ranks the pairs of one range of the sorted order: dense, from 0, over the pairs that stand twice or more.

    Pairs that stand once leave. The first and the last pair of the range stay whatever they are, for they may go on
    in the next range; a marker row (edge 1 and 2, doc null) has their keys, and the last one the number of ranks.
    """
    part, next_rank, first, key, started, held = TaskContext.get().partitionId(), 0, None, None, False, None

    def rows(cols, rank, again):
        n = len(rank)
        none = pa.nulls(n, pa.int64())
        return _batch(_RANKED, np.full(n, part, np.int32), rank, *cols[2:], again, np.zeros(n, np.int32), none, none)

    def marker(edge, pair):
        none = pa.nulls(1, pa.int64())
        return _batch(_RANKED, pa.array([part], pa.int32()), pa.array([next_rank]), none, none, none, pa.array([False]), pa.array([edge], pa.int32()), pa.array([pair[0]], pa.int64()), pa.array([pair[1]], pa.int64()))

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        a, b = cols[0], cols[1]
        if not len(a):
            continue
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(a)))
        goes_on = started and (a[0], b[0]) == key
        if first is None:
            first = int(a[0]), int(b[0])
        keep = size > 1
        keep[0] |= goes_on or next_rank == 0 and not started
        alone = size[-1] == 1 and not keep[-1]  # may still get a second row
        fresh = keep.copy()
        fresh[0] &= not goes_on
        rank = next_rank - 1 + np.cumsum(fresh)
        pick = np.repeat(keep, size)
        again = ~new
        again[0] |= goes_on
        if pick.any():
            yield rows([c[pick] for c in cols], np.repeat(rank, size)[pick], again[pick])
        next_rank += int(fresh.sum())
        key, started, held = (int(a[-1]), int(b[-1])), not alone, [c[-1:] for c in cols] if alone else None
    if held is not None:
        yield rows(held, np.array([next_rank]), np.array([False]))
        next_rank += 1
    if first is not None:
        yield marker(1, first)
        yield marker(2, key)


def ranked(scratch: Scratch, name: str, pairs: DataFrame) -> DataFrame:
    """Sorts rows (a, b, doc, sub, at) by all columns and ranks their pairs: (rank, doc, sub, at, again), without pairs that stand once.

    The order is cut into ranges by sampled keys that include the place, so a pair that is everywhere spreads over
    tasks. Two rows a range come to the driver, which shifts each range's ranks behind those before it and tells where
    a pair goes on from one range to the next. again: not the first of its pair. Equal ranks mean equal pairs.
    """
    spark, keys = scratch.spark, _names(_PAIR)
    table = scratch.table(name, pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_ranks, _RANKED))
    ends = {(r.edge, r.part): (r.a, r.b, r["rank"]) for r in table.where("edge > 0").select("edge", "part", "rank", "a", "b").collect()}
    base, before, shifts = 0, None, []
    for part in sorted(p for e, p in ends if e == 1):
        goes_on = ends[1, part][:2] == before
        shifts.append((part, base - goes_on, goes_on))
        before, count = ends[2, part][:2], ends[2, part][2]
        base += count - goes_on
    moved = spark.createDataFrame(shifts, "part int, shift long, goes_on boolean")
    return table.where("edge = 0").join(F.broadcast(moved), "part").select((F.col("rank") + F.col("shift")).alias("rank"), "doc", "sub", "at", (F.col("again") | ((F.col("rank") == 0) & F.col("goes_on"))).alias("again"))


def _next_pairs(step: int):
    """Of rows (doc, sub, block, at, rank) in order, those an open window begins at, with the rank that stands step further on.

    A place whose partner is missing had a rank that stands once, so its window is unique and leaves.
    """

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            doc, sub, block, at, rank = cols
            new = np.append(False, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (block[1:] != block[:-1]))
            group = np.cumsum(new)
            later = (group == group[-1]) & ((at >> 1) + step > at[-1] >> 1)
            yield from found(cols, group, ~later)
            held = [c[later] for c in cols]
        if held is not None and len(held[0]):
            yield from found(held, np.zeros(len(held[0]), np.int64), np.ones(len(held[0]), bool))

    def found(cols, group, ready):
        doc, sub, _, at, rank = cols
        key = (group << 33) + (at >> 1)
        own = np.flatnonzero(ready & ((at & 1) == 1))
        slot = np.minimum(np.searchsorted(key, key[own] + step), len(key) - 1)
        there = key[slot] == key[own] + step
        own, slot = own[there], slot[there]
        if len(own):
            yield _batch(_PAIR, rank[own], rank[slot], doc[own], sub[own], at[own] >> 1)

    return run


_KEPT = "doc long, sub long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _cut_out(batches):
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            raw, offsets = text_bytes(part.column(2))
            spans, kept = [], []
            for i, packed in enumerate(part.column(3)):
                n, data = int(offsets[i + 1] - offsets[i]), raw[offsets[i] : offsets[i + 1]]
                found = np.sort(packed.values.to_numpy()) if packed.is_valid else np.zeros(0, np.int64)
                start, stop = found >> 31, np.minimum((found >> 31) + (found & ((1 << 31) - 1)), n)
                start, stop = start[stop > start], np.maximum.accumulate(stop[stop > start]) if len(found) else stop
                head = np.ones(len(start), bool)
                head[1:] = start[1:] > stop[:-1]
                a, b = start[head], stop[np.append(np.flatnonzero(head)[1:], len(start)) - 1] if len(start) else stop
                spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
                keep = np.ones(n, bool)
                for x, y in zip(a.tolist(), b.tolist()):
                    keep[x:y] = False
                kept.append(data[keep].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=[f.strip().split()[0] for f in ("doc", "sub", "n_bytes", "spans", "kept")])


def in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Gives rows (doc, text) a number sub, so that (doc, sub) is unique and in order: rows of one doc by the MD5 of their texts."""
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("sub"), "text")
    keyed = rows.withColumn("h", F.md5(F.coalesce("text", F.lit("")))).withColumn("m", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange("doc", "h", "m").sortWithinPartitions("doc", "h", "m")
    return scratch.table("rows", placed.select("doc", F.monotonically_increasing_id().alias("sub"), "text"))


def _by_doc(opened: DataFrame) -> DataFrame:
    return opened.groupBy(F.col("doc").alias("d"), F.col("sub").alias("s")).agg(F.collect_list(F.struct("start", "windows", "at")).alias("runs"))


def _sifted(scratch: Scratch, tag: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs by key, (those that repeat an earlier run whole, the first ones of keys that stand for different runs).

    Runs whose key stands nowhere else are unique and leave. Keys meet by partial aggregation and by joins of written
    tables, which AQE splits, so a key that is everywhere costs a row a task and then is dealt like any other.
    """
    runs = scratch.table(tag, rows)
    keys = scratch.table(f"{tag}-keys", runs.where("not done").groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"))
    shared = scratch.table(f"{tag}-shared", runs.where("not done").join(keys, F.col("key") == F.col("k"), "left_semi"))
    classes = scratch.table(f"{tag}-classes", shared.groupBy(F.col("key").alias("k"), F.col("span").alias("s")).agg(F.min(F.struct("doc", "sub", "start", "windows", "at")).alias("first"), F.count("*").alias("n")))
    place = ("doc", "sub", "start")
    again = shared.join(classes.where("n > 1"), (F.col("key") == F.col("k")) & (F.col("span") == F.col("s"))).where(F.struct(*place) != F.struct(*[F.col(f"first.{c}") for c in place]))
    repeats = scratch.table(f"{tag}-repeats", again.select(*place, "windows").unionByName(runs.where("done").select(*place, "windows")))
    scratch.drop(tag, f"{tag}-keys", f"{tag}-shared")
    varied = scratch.table(f"{tag}-varied", classes.groupBy(F.col("k").alias("v")).agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("v"))
    opened = scratch.table(f"{tag}-opened", classes.join(varied, F.col("k") == F.col("v"), "left_semi").select("first.*"))
    scratch.drop(f"{tag}-classes", f"{tag}-varied")
    return repeats, opened


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 100, gram: int = 40, few: int = 16, stretch: int = 4 << 20) -> DataFrame:
    """Removes every byte covered by a size-byte string that also starts earlier: (id, n_bytes, spans, kept).

    An exact filter first: each window of size bytes stands under its least gram by hash, which equal windows choose
    alike; windows in a row with the same gram are one run. Runs whose gram stands nowhere else are unique and leave,
    and of runs equal in all bytes all but the first are repeats. Where a gram stands in different runs, the first ones
    are cut into runs of `few` windows and sifted once more, by the bytes that all windows of such a run share. What is
    left goes through prefix doubling place by place: names of a quarter of the size are paired at one offset (25 for
    100), Spark sorts the pairs and gives dense ranks, pairs that stand once leave, and the ranks are paired and
    sorted again at the next offset (50); of equal pairs all but the first place are repeats. Sorted orders are cut by
    key and place, keys that are everywhere meet by partial aggregation and joins that AQE splits: no key needs a
    task of its own. Only two rows a task come to the driver.

    Earlier is by id, then by place; a null id is below all others; rows that repeat an id follow each other in the
    order of their texts' MD5. Null and short texts lose nothing. Equality of runs is told by 128 bits of hash, of names
    by 64 (see span_hashes). spans are the removed runs [start, stop) in bytes; kept is the rest, which may cut a
    character. Other columns are ignored; an empty table gives no rows. gram is at least 8 and at most size.
    """
    if not 8 <= gram <= size:
        raise ValueError("gram must be 8 to size")
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = in_order(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text_col).alias("text")), scratch)
    of_row = (F.col("doc") == F.col("d")) & (F.col("sub") == F.col("s"))
    gone, opened = _sifted(scratch, "runs", rows.mapInArrow(_runs(size, gram, stretch), _RUN))
    cores = rows.join(_by_doc(opened), of_row).select("doc", "sub", "text", "runs").mapInArrow(_cores(size, gram, few), _RUN)
    more, opened = _sifted(scratch, "cores", cores)
    still = scratch.table("still", rows.join(_by_doc(opened), of_row).select("doc", "sub", "text", "runs"))
    first, second = steps(size)
    half = ranked(scratch, "half", still.mapInArrow(_first_pairs(size), _PAIR)).select("doc", "sub", F.expr("at div 2097152").alias("block"), "at", "rank")
    scratch.drop("still")
    # the first places of a block also stand at the end of the one before it, as second halves only
    edge = half.where(F.expr(f"block > 0 and at % 2097152 < {2 * second}")).select("doc", "sub", (F.col("block") - 1).alias("block"), F.expr("at - at % 2").alias("at"), "rank")
    paired = scratch.table("paired", half.unionByName(edge).repartition("doc", "sub", "block").sortWithinPartitions("doc", "sub", "block", "at").mapInArrow(_next_pairs(second), _PAIR))
    scratch.drop("half")
    whole = ranked(scratch, "whole", paired)
    gone = gone.unionByName(more).unionByName(whole.where("again").select("doc", "sub", F.col("at").alias("start"), F.lit(1).alias("windows")))
    packed = (F.shiftleft("start", 31) + F.col("windows") + (size - 1)).alias("x")
    found = scratch.table("found", gone.select("doc", "sub", packed).groupBy(F.col("doc").alias("d"), F.col("sub").alias("s")).agg(F.collect_list("x").alias("x")))
    scratch.keep("found", "rows")
    cut = rows.join(found, of_row, "left").select("doc", "sub", "text", "x").mapInArrow(_cut_out, _KEPT)
    return cut.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("id"), "n_bytes", "spans", "kept")
