"""Benchmark decontamination by a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, eights, same_spans, slices, text_bytes
from .words import ALPHANUMERIC, Words


@dataclass
class WindowIndex:
    """Windows of items under their rarest word, as arrays: about 50 bytes a word of the items, and their text."""

    raw: np.ndarray  # the items' text, lower-cased
    begin: np.ndarray  # of each word of it
    end: np.ndarray
    prefix: np.ndarray  # different prefix words by hash, sorted
    first: np.ndarray  # of each, its first window; one more at the end
    place: np.ndarray  # of each different window, where in it its prefix word stands
    start: np.ndarray  # its first word
    size: np.ndarray
    hash: np.ndarray
    holders: np.ndarray  # its first place in items; one more at the end
    items: np.ndarray
    sieve: np.ndarray  # bit table over the low bits of prefix words

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())

    def occurrences(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every window occurrence in the documents."""
        if not len(self.prefix) or not len(docs.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.sieve[(docs.hash & np.uint64(len(self.sieve) - 1)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.prefix, docs.hash[at]), len(self.prefix) - 1)
        found = self.prefix[slot] == docs.hash[at]
        at, slot = at[found], slot[found]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        count = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        for a, b in portions(count):  # a common word with many windows is tried a portion at a time
            size = count[a:b]
            entry = np.repeat(self.first[slot[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            doc = np.repeat(np.searchsorted(docs.first, at[a:b], "right") - 1, size)
            start = np.repeat(at[a:b], size) - self.place[entry]
            fits = (start >= docs.first[doc]) & (start + self.size[entry] <= docs.first[doc + 1])  # positional bounds
            start, entry = start[fits], entry[fits]
            same = docs.runs(start, self.size[entry]) == self.hash[entry]
            start, entry = start[same], entry[same]
            sure = self._same_words(docs, start, entry)  # exact
            out.append((start[sure], entry[sure]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _same_words(self, docs: Words, start: np.ndarray, entry: np.ndarray) -> np.ndarray:
        here, there = eights(docs.raw), eights(self.raw)
        out = np.ones(len(start), bool)
        for k in range(int(self.size[entry].max(initial=0))):
            live = np.flatnonzero(out & (self.size[entry] > k))
            a, b = start[live] + k, self.start[entry[live]] + k
            size = docs.end[a] - docs.begin[a]
            same = size == self.end[b] - self.begin[b]
            same[same] = same_spans(here, docs.begin[a][same], self.begin[b][same], size[same], there)
            out[live] = same
        return out


def portions(count: np.ndarray, most: int = 1 << 20):
    """Cuts a list of counts into portions that hold about `most` together."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        b = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, b
        at = b


def item_words(texts: pa.Array) -> Words:
    return Words(*text_bytes(texts), ALPHANUMERIC)


def build_index(items: np.ndarray, words: Words, counts: dict[int, int], window: int) -> WindowIndex:
    """Puts each window of `window` words under its rarest one: a containment of all words needs a prefix of one in the order of rarity.

    items: the id of each text of words; a text of fewer words than a window is one window, one without any has none.
    """
    n = np.diff(words.first)
    many = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    start = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(window, n[text])
    hashes, vocabulary = words.runs(start, size), np.unique(words.hash)
    common = np.array([counts.get(h, 0) for h in vocabulary.tolist()], np.int64)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, common))] = np.arange(len(vocabulary))
    of = rank[np.searchsorted(vocabulary, words.hash)]
    place, best = np.zeros(len(start), np.int8), np.full(len(start), 1 << 62)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        less = live[of[start[live] + k] < best[live]]
        best[less], place[less] = of[start[less] + k], k
    key = words.hash[start + place] if len(start) else np.zeros(0, np.uint64)
    # equal windows are one entry with all the items that hold it: by hash, and told apart by their words
    order = np.lexsort((items[text], hashes, size, key))
    out = WindowIndex(words.raw, words.begin.astype(np.int32), words.end.astype(np.int32), *[np.zeros(0)] * 2, place[order], start[order].astype(np.int32), size[order].astype(np.int8), hashes[order], np.zeros(0), items[text[order]], np.zeros(0, bool))
    key = key[order]
    new = np.ones(len(order), bool)
    if len(order):
        alike = np.flatnonzero((key[1:] == key[:-1]) & (out.hash[1:] == out.hash[:-1]) & (out.size[1:] == out.size[:-1])) + 1
        new[alike[out._same_words(words, out.start[alike - 1].astype(np.int64), alike)]] = False
    lead = np.flatnonzero(new)
    out.holders = np.append(lead, len(order)).astype(np.int32)
    out.place, out.start, out.size, out.hash = (v[lead] for v in (out.place, out.start, out.size, out.hash))
    out.prefix, first = np.unique(key[lead], return_index=True)
    out.first = np.append(first, len(lead)).astype(np.int32)
    out.sieve = np.zeros(1 << 16 if len(out.prefix) < 1 << 12 else 1 << 22, bool)
    out.sieve[(out.prefix & np.uint64(len(out.sieve) - 1)).astype(np.int64)] = True
    return out


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> dict[int, int]:
    """How often each of the given word hashes stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def run(batches):
        own = shared.value
        total = np.zeros(len(own), np.int64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(own & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, "text"):
                h = Words(*text_bytes(part.column(0)), ALPHANUMERIC).hash
                h = h[sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]]
                slot = np.minimum(np.searchsorted(own, h), len(own) - 1)
                total += np.bincount(slot[own[slot] == h], minlength=len(own))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own[seen].view(np.int64)), pa.array(total[seen])], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word % (1 << 64): r.n for r in rows}


def _cut_items(window: int, most: int):
    """Items in parts of about `most` bytes that have window - 1 words in common, so that each window stands in one."""

    def run(batches):
        for batch in batches:
            items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for item, text in zip(items, texts):
                if text is None or len(text) <= most:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([0], pa.int32()), pa.array([text or ""], pa.string())], names=["item", "part", "text"])
                    continue
                words = item_words(pa.array([text], pa.string()))
                at, part = 0, 0
                while at < len(words.begin):
                    stop = max(at + window, int(np.searchsorted(words.end, words.begin[at] + most, "right")))
                    stop = len(words.begin) if stop + window > len(words.begin) else stop
                    own = words.raw[words.begin[at] : words.end[stop - 1]].tobytes().decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([part], pa.int32()), pa.array([own], pa.string())], names=["item", "part", "text"])
                    at, part = (stop if stop == len(words.begin) else stop - window + 1), part + 1

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Appends to each document n_words, hits (runs of words, [start, stop)) and items (ids whose windows occur).

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A window is
    `window` consecutive words of an item (64 at most); a shorter item is one window. Each window stands in an index
    under its rarest word over all documents; only where a document has that word is a window tried: it must fit the
    document there, agree by hash, and then word for word. The index is broadcast in blocks of about block_bytes of
    item text (documented bound; longer items are cut with window - 1 words in common), one after the other, and takes 25
    times that at most, for items of one-letter words. The documents are never shuffled; each block reads them twice.

    Null texts have no words; null item ids are left out; repeated items and rows stay as they are. Columns named
    like a result are replaced; others stay. An empty benchmark gives no hits, an empty table no rows.
    """
    if not 1 <= window <= 64:
        raise ValueError("a window has 1 to 64 words")
    scratch = Scratch(docs.sparkSession, "benchmark")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    items = scratch.table("items", items.mapInArrow(_cut_items(window, block_bytes // 4), "item long, part int, text string"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-total // block_bytes)
    out = docs.drop("n_words", "hits", "items").selectExpr("*", "CAST(NULL AS long) AS n_words", "CAST(array() AS array<struct<start:int,stop:int>>) AS hits", "CAST(array() AS array<long>) AS items")
    for k in range(max(1, blocks)):
        part = items if blocks <= 1 else items.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == k)
        held = part.orderBy("item", "part", "text").toArrow()
        words = item_words(held.column("text").combine_chunks() if held.num_rows else pa.array([], pa.string()))
        vocabulary = np.unique(words.hash)
        counts = word_counts(docs, vocabulary, text_col) if len(vocabulary) else {}
        shared = docs.sparkSession.sparkContext.broadcast(build_index(held.column("item").to_numpy().astype(np.int64), words, counts, window))
        out = out.mapInArrow(_mark(shared, text_col), out.schema)
    return out


def _mark(shared, text_col):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                docs = Words(*text_bytes(part.column(text_col)), ALPHANUMERIC)
                n = part.num_rows
                start, entry = index.occurrences(docs)
                before = part.column("hits")
                doc = np.searchsorted(docs.first, start, "right") - 1 if len(start) else start
                spans = [list(map(lambda h: (h["start"], h["stop"]), x)) if x else [] for x in before.to_pylist()]
                items = [set(x) for x in part.column("items").to_pylist()]
                begin = start - docs.first[doc]
                for d, s, e in zip(doc.tolist(), begin.tolist(), (begin + index.size[entry]).tolist()):
                    spans[d].append((s, e))
                for d, e in set(zip(doc.tolist(), entry.tolist())):
                    items[d].update(index.items[index.holders[e] : index.holders[e + 1]].tolist())
                hits = [[{"start": a, "stop": b} for a, b in merged(x)] for x in spans]
                new = {"n_words": pa.array(np.diff(docs.first)[:n]), "hits": pa.array(hits, before.type), "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([new.get(name, part.column(i)) for i, name in enumerate(part.schema.names)], names=part.schema.names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
