"""Exact n-gram Jaccard join: signatures bring similar sets together, prefix trees verify them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, mixed, slices, text_bytes, told
from .words import UNSPACED, Words

_META = "kind byte, id long, n long, h1 long, h2 long, near0 binary, near1 binary"
_TOKEN = "token long, salt int, id long, n int, at int, before long"
_MET = "kind byte, token long, id long, n int, other long, other_n int"
_SALT = np.uint64(0x9FB21C651E98DF25)
#: Cells that shingles are counted in; a cell's weight is the bit length of its count. Tokens of at least this weight are salted.
_CELLS, _HOT = 1 << 20, 14
#: Bits of the number of cells that tell repeated tokens (16 MB), and of a token's mark that is sent.
_MARKS, _MARK = 27, np.uint64((1 << 40) - 1)
#: Classes of equal sets that tasks are told of.
_TWINS = 1 << 19
#: Up to so many links are joined by the driver (4 MB), more by rounds of jobs.
_AT_DRIVER = 1 << 18
#: Sets of a part of a large block, as histograms; blocks of more parts than this are not cut by them.
_PART, _PARTS = 1 << 12, 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's different shingles, n + 1 offsets into them); a text of fewer words is one shingle, one of none has none."""
    words = Words(raw, offsets, UNSPACED)
    count = np.diff(words.first)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), many)
    start = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    run = np.minimum(size, count[doc])
    hashes = words.runs(start, run) + run.astype(np.uint64)
    new = ~pd.Series(hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1))).duplicated().to_numpy()
    hashes, doc = hashes[new], doc[new]
    return hashes, np.append(0, np.cumsum(np.bincount(doc, minlength=len(count))))


class Levels:
    """Set sizes cut so that two sets of enough similarity are of one level or of neighbouring ones."""

    def __init__(self, percent: int, most: int = 1 << 40):
        starts = [1]
        while starts[-1] <= most:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts, np.int64)
        large = self.starts[1:] - 1
        #: the largest symmetric difference of a similar pair whose smaller set is of the level
        self.differ = (large + large * 100 // percent) * (100 - percent) // (100 + percent)
        self.buckets = np.where(self.differ == 0, 1, self.differ + 2 + self.differ * 3 // 100)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1


def in_order(hashes: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The order that sorts each set by the one global order: weight of the shingle's cell (rare ones first), then hash."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.lexsort((hashes, weights[_cell(hashes)], doc))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes + _SALT) & np.uint64(_CELLS - 1)).astype(np.int64)


def prefixes(hashes: np.ndarray, offsets: np.ndarray, percent: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, place) of each set's first shingles in the global order, so many that two similar sets have one in common."""
    n = np.diff(offsets)
    many = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
    order = in_order(hashes, offsets, weights)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, hashes[order[offsets[text] + place]], place


def histograms(hashes: np.ndarray, offsets: np.ndarray, levels: Levels, shift: int) -> list[bytes]:
    """Each set's elements counted in cells by hash, of each count whether it is odd: a bit a cell, two cells or more an
    element at its level (up to 2^15 of them). Two sets differ in at least as many elements as there are cells whose bits differ."""
    n = np.diff(offsets)
    level = np.maximum(levels.of(n) - shift, 0)
    words = np.minimum(levels.starts[level] // 32 + 1, 512)
    base = np.append(0, np.cumsum(8 * words))
    doc = np.repeat(np.arange(len(n)), n)
    slot = 8 * base[doc] + (mixed(hashes + _SALT) % (64 * words[doc]).astype(np.uint64)).astype(np.int64)
    odd = np.packbits(np.bincount(slot, minlength=int(8 * base[-1])).astype(np.uint8) & 1).tobytes()
    return [odd[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different unordered pairs of different ids."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    different = low != high
    both = np.unique(np.stack([low[different], high[different]], 1), axis=0)
    return both[:, 0], both[:, 1]


def _meta(size: int, percent: int):
    """A row a set: its size, two sums that tell equal sets, and its histograms; and, as kind 1, the cells that hold
    clearly more shingles of this task than most do: (cell, count)."""

    def rows(kind, *columns):
        kinds = pa.array(np.full(len(columns[0]), kind, np.int8))
        return pa.RecordBatch.from_arrays([kinds, *columns], names=[f.strip().split()[0] for f in _META.split(",")])

    def run(batches):
        levels, seen = Levels(percent), np.zeros(_CELLS, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = shingle_sets(*text_bytes(part.column(1)), size)
                np.add(seen, np.bincount(_cell(hashes), minlength=_CELLS).astype(np.int32), out=seen)
                near = [pa.array(histograms(hashes, offsets, levels, shift), pa.binary()) for shift in (0, 1)]
                yield rows(0, part.column(0), pa.array(np.diff(offsets)), *map(pa.array, set_sums(hashes, offsets)), *near)
        often = np.flatnonzero(seen > seen.mean() + 1.6 * np.sqrt(seen.mean()))
        none = pa.nulls(len(often), pa.int64())
        yield rows(1, pa.array(often), pa.array(seen[often].astype(np.int64)), none, none, pa.nulls(len(often), pa.binary()), pa.nulls(len(often), pa.binary()))

    return run


def set_sums(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set that are equal for equal sets."""
    some, end = np.diff(offsets) > 0, np.uint64(0)  # the end belongs to no set, so it adds nothing to the last one
    return [np.where(some, np.add.reduceat(np.append(mixed(hashes ^ salt), end), offsets[:-1]), np.uint64(0)).astype(np.uint64).view(np.int64) if len(some) else np.zeros(0, np.int64) for salt in (np.uint64(0), _SALT)]


def _prefix_rows(size: int, percent: int, weights, twins=None):
    """Of a run of rows (id, text): (ids, set sizes, text, token, place) of the prefix tokens, text by text; of equal sets
    only the one of the smallest id has any, and rows without an id have none. twins: (two sums, smallest id) of sets that
    stand in several rows, by the first sum, so that of these one row of all has tokens."""

    def run(part):
        hashes, offsets = shingle_sets(*text_bytes(part.column(1)), size)
        n, ids = np.diff(offsets), part.column(0).fill_null(0).to_numpy()
        one, two = set_sums(hashes, offsets)
        order = np.lexsort((ids, n, two, one))
        chosen = np.asarray(part.column(0).is_valid()).copy()
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (n[order][1:] == n[order][:-1])
        chosen[order[1:][same & chosen[order][:-1]]] = False
        if twins is not None and len(twins.value[0]):
            c1, c2, lead = twins.value
            at = np.minimum(np.searchsorted(c1, one), len(c1) - 1)
            chosen &= (c1[at] != one) | (c2[at] != two) | (lead[at] == ids)
        text, token, place = prefixes(hashes, offsets, percent, weights.value)
        keep = chosen[text]
        return ids, n, text[keep], token[keep], place[keep]

    return run


class Marks:
    """One bit for each of a power of two of cells, in parts that are filled apart: a token's part by its upper bits, its cell there by its mark."""

    def __init__(self, tokens: int):
        """tokens: about how many there are; a part holds about 2^20 of them, all cells take 16 MB at most."""
        self.part_bits = max((tokens >> 20).bit_length(), 4)
        self.cell_bits = min(max((tokens >> 1).bit_length(), 16), _MARKS) - self.part_bits

    def parts(self, mixed_tokens: np.ndarray) -> np.ndarray:
        return (mixed_tokens >> np.uint64(64 - self.part_bits)).astype(np.int64)

    def cells(self, marks: np.ndarray) -> np.ndarray:
        return (marks & np.uint64((1 << self.cell_bits) - 1)).astype(np.int64)

    def bits(self, marks: np.ndarray) -> bytes:
        """A part's cells: those of its marks that stand twice or more often."""
        marks = np.sort(marks)
        out = np.zeros(1 << self.cell_bits, bool)
        out[self.cells(marks[1:][marks[1:] == marks[:-1]])] = True
        return np.packbits(out, bitorder="little").tobytes()

    def has(self, bits: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = mixed(token)
        at = (self.parts(key) << self.cell_bits) + self.cells(key & _MARK)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _sent_marks(size: int, percent: int, weights, twins, marks: Marks, most: int = 1 << 19):
    """The marks (five bytes of the mixed token) of all prefix tokens, a row for each part; of equal ones two at most from `most` tokens."""

    def rows(held):
        key = np.sort(np.concatenate(held))
        key = key[np.append(np.ones(min(2, len(key)), bool), key[2:] != key[:-2])]
        part = marks.parts(key)
        lead = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        five = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        ends = np.append(lead[1:], len(key))
        return pa.RecordBatch.from_arrays([pa.array(part[lead].astype(np.int32)), pa.array([five[a:b].tobytes() for a, b in zip(lead.tolist(), ends.tolist())], pa.binary())], names=["part", "marks"])

    def run(batches):
        prefix, held, count = _prefix_rows(size, percent, weights, twins), [], 0
        for batch in batches:
            for cut in slices(batch, "text"):
                token = prefix(cut)[3]
                if len(token):
                    held.append(mixed(token))
                    count += len(token)
                if count >= most:
                    yield rows(held)
                    held, count = [], 0
        if held:
            yield rows(held)

    return run


def _repeated(marks: Marks):
    """Of rows (part, marks) sorted by part: the bits of each part."""

    def bits(part, held):
        five = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 5)
        key = np.zeros((len(five), 8), np.uint8)
        key[:, :5] = five
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([marks.bits(key.view("<u8").ravel())], pa.binary())], names=["part", "bits"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and held:
                    yield bits(now, held)
                    held = []
                now = part
                held.append(own)
        if held:
            yield bits(now, held)

    return run


def repeated_tokens(scratch: Scratch, rows: DataFrame, size: int, percent: int, weights, twins, tokens: int) -> tuple[Marks, np.ndarray]:
    """Marks of the prefix tokens of more than one row, and their bits: every such token has its bit, few others have."""
    marks = Marks(tokens)
    sent = rows.mapInArrow(_sent_marks(size, percent, weights, twins, marks), "part int, marks binary").repartition("part").sortWithinPartitions("part")
    found = scratch.table("bits", sent.mapInArrow(_repeated(marks), "part int, bits binary")).toArrow()  # 16 MB at most
    scratch.drop("bits")
    each = 1 << marks.cell_bits >> 3
    out = np.zeros(each << marks.part_bits, np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        out[part * each : (part + 1) * each] = np.frombuffer(bits, np.uint8)
    return marks, out


def _twins(classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two sums, smallest id) of classes of several rows, by the first sum: all, or so many of them by hash (12 MB). A class left out costs work only."""
    several = classes.where("copies > 1")
    count = several.count()
    found = (several if count <= _TWINS else several.where(F.pmod("c1", F.lit(count)) < _TWINS)).select("c1", "c2", "lead").toArrow()
    c1, c2, lead = (found.column(c).to_numpy() for c in ("c1", "c2", "lead"))
    order = np.argsort(c1)
    return c1[order], c2[order], lead[order]


def _tokens(size: int, percent: int, weights, twins=None, marks: Marks | None = None, bits=None):
    """Prefix rows of the tokens that have a bit (of all without marks), each with the one of them before it in its set
    (0 for the first). Tokens of heavy cells get a salt."""

    def run(batches):
        prefix = _prefix_rows(size, percent, weights, twins)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n, text, token, place = prefix(part)
                if marks is not None:
                    keep = marks.has(bits.value, token)
                    text, token, place = text[keep], token[keep], place[keep]
                if not len(token):
                    continue
                before = np.where(np.append(False, text[1:] == text[:-1]), np.append(np.uint64(0), token[:-1]), np.uint64(0))
                salts = 1 << np.maximum(weights.value[_cell(token)].astype(np.int64) - _HOT + 2, 0)
                salt = np.where(salts > 4 - 1, 1 + (mixed(ids[text].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids[text]), pa.array(n[text].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(before.view(np.int64))], names=[f.strip().split()[0] for f in _TOKEN.split(",")])

    return run


def _meeting(few: int, percent: int, members: bool = False):
    """Of rows sorted by token, salt and size, what may link by a token that both have.

    Groups of up to few rows without a salt give their pairs (kind 0) whose sizes and places leave room for enough
    overlap; not those with the same token before this one, which meet under that one too. Larger ones give chains
    (kind 1): each row with the next one, unless the next is too large for any link with this one or a smaller one; so
    whatever links is in one chain, however large the group is. With members, those without a salt give their rows
    (kind 3, other: the token before in the set) instead. Salted groups give their chains, and of each chain its sizes (kind 2: id, n to other_n), to be
    chained over all salts.
    """

    def rows(kind, token, a, an, b, bn):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *(pa.array(v.astype(t)) for v, t in ((token, np.int64), (a, np.int64), (an, np.int32), (b, np.int64), (bn, np.int32)))], names=[f.strip().split()[0] for f in _MET.split(",")])

    def small(cols, start, size):
        token, _, ids, n, at = cols[:5]
        before = cols[5] if len(cols) > 5 else np.arange(len(at))
        first, second = [], []
        for s in range(2, few + 1):
            own = start[size == s]
            if len(own):
                group = own[:, None] + np.arange(s)
                i, j = np.triu_indices(s, 1)
                first.append(group[:, i].ravel())
                second.append(group[:, j].ravel())
        if not first:
            return
        x, y = np.concatenate(first), np.concatenate(second)
        need = -(-percent * (n[x].astype(np.int64) + n[y]) // (100 + percent))
        fits = (ids[x] != ids[y]) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need) & ((before[x] != before[y]) | (before[x] == 0))
        x, y = x[fits], y[fits]
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        table = pd.DataFrame({"a": ids[x], "an": n[x], "b": ids[y], "bn": n[y]}).drop_duplicates()
        if len(table):
            yield rows(0, np.zeros(len(table)), *(table[c].to_numpy() for c in ("a", "an", "b", "bn")))

    def run(batches):
        held, large, last = None, None, None  # rows of a group that may go on; a group known to be large and its last row; its chain so far
        chain = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
                held = None
            token, salt, ids, n = cols[:4]
            if not len(token):
                continue
            new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(token)))
            goes_on = large == (token[0], salt[0])
            chained = (size > few) | (salt[start] > 0)
            chained[0] |= goes_on
            if not chained[-1]:
                held = [c[start[-1] :] for c in cols]
            yield from small(cols, *((start[~chained], size[~chained]) if held is None else (start[~chained][:-1], size[~chained][:-1])))
            at = np.flatnonzero(np.repeat(chained, size))
            if chain is not None and not goes_on:
                yield from segments([chain])
                chain, last = None, None
            large = (token[-1], salt[-1]) if chained[-1] else None
            chains_on = large is not None and not (members and large[1] == 0)
            if members:
                plain, at = at[salt[at] == 0], at[salt[at] > 0]
                if len(plain):
                    before = cols[5] if len(cols) > 5 else np.zeros(len(token))
                    yield rows(3, token[plain], ids[plain], n[plain], before[plain], n[plain])
            if len(at):
                t, s, i, m = (c[at] for c in (token, salt, ids, n))
                if last is not None:
                    t, s, i, m = (np.append(v, w) for v, w in zip(last, (t, s, i, m)))
                joined = (t[1:] == t[:-1]) & (s[1:] == s[:-1]) & (100 * m[:-1].astype(np.int64) >= percent * m[1:].astype(np.int64))
                k = np.flatnonzero(joined & (i[1:] != i[:-1]))
                if len(k):
                    yield rows(1, t[k], i[k], m[k], i[k + 1], m[k + 1])
                head = np.append(True, ~joined)
                lead = np.flatnonzero(head)
                stop = np.append(lead[1:], len(t)) - 1
                found = [(int(t[x]), int(s[x]), int(i[x]), int(m[x]), int(m[y])) for x, y in zip(lead.tolist(), stop.tolist()) if s[x] > 0]
                if chain is not None and found and found[0][:2] == chain[:2] and not head[1:2].all():
                    found[0] = (*chain[:4], found[0][4])
                elif chain is not None:
                    found.insert(0, chain)
                open_ = chains_on and s[-1] > 0
                yield from segments(found[:-1] if open_ else found)
                chain = found[-1] if open_ else None
                last = tuple(v[-1:] for v in (t, s, i, m)) if chains_on else None
        if held is not None:
            start = np.array([0])
            yield from small(held, start, np.array([len(held[0])]))
        if chain is not None:
            yield from segments([chain])

    def segments(found):
        if found:
            t, _, i, a, b = (np.array(v) for v in zip(*found))
            yield rows(2, t, i, a, i, b)

    return run


def _over_salts(percent: int):
    """Chains the segments of each token (id, n to other_n), sorted by token and n: links of those near enough in size."""

    def run(batches):
        now, reach, lead = None, 0, None
        for batch in batches:
            out = []
            for token, i, low, high in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if token == now and 100 * reach >= percent * low:
                    out.append((lead, i))
                    reach = max(reach, high)
                else:
                    now, reach = token, high
                lead = i
            out = [(a, b) for a, b in out if a != b]
            if out:
                yield _batch(*(np.array(v, np.int64) for v in zip(*out)))

    return run


def _close_pairs(percent: int):
    """Of pairs (id, n, its histograms, other, other_n, the other's), those near enough for a link: compared at the level of the smaller set."""

    def run(batches):
        levels = Levels(percent)
        for batch in batches:
            n, other = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 5))
            low = np.minimum(levels.of(n), levels.of(other))
            down, other_down = levels.of(n) - low, levels.of(other) - low
            keep = np.flatnonzero((down < 2) & (other_down < 2))
            if not len(keep):
                continue
            x, y = ([batch.column(c + int(d))[int(k)].as_buffer() for k, d in zip(keep.tolist(), s[keep].tolist())] for c, s in ((2, down), (6, other_down)))
            size = np.array([b.size >> 3 for b in x])
            x, y = (np.frombuffer(b"".join(v), np.uint64) for v in (x, y))
            apart = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), np.cumsum(size) - size)
            near = keep[apart <= (n[keep] + other[keep]) * (100 - percent) // (100 + percent)]
            yield _batch(batch.column(0).to_numpy()[near], batch.column(4).to_numpy()[near])

    return run


def _close_members(percent: int, most: int):
    """Of rows (token, id, n, its histograms) sorted by token and n, what may link within each token's group: pairs near
    enough by histogram, one for each two parts that they bring together. Groups of more than most rows are chained by size."""
    levels = Levels(percent)

    def near(parts):
        rows = pa.Table.from_batches(parts)
        ids, n = rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
        own, up = (rows.column(c).to_pylist() for c in (3, 4))
        level, group, out = levels.of(n), np.arange(len(n)), []
        for now in np.unique(level).tolist():
            a, b, c = np.searchsorted(level, [now, now + 1, now + 2]).tolist()  # rows of the level, then those of the next one
            odd = np.frombuffer(b"".join(own[a:b] + up[b:c]), np.uint64).reshape(c - a, -1)
            end = np.searchsorted(n[a:c], 100 * n[a:b] // percent, "right")
            for k in range(b - a):
                w = np.arange(k + 1, end[k])
                w = w[group[a + w] != group[a + k]]
                if len(w):
                    apart = np.bitwise_count(odd[w] ^ odd[k]).sum(1, dtype=np.int64)
                    w = a + w[apart <= (n[a + k] + n[a + w]) * (100 - percent) // (100 + percent)]
                    joined, first = np.unique(group[w], return_index=True)
                    out.append((np.full(len(first), ids[a + k]), ids[w[first]]))
                    group[np.isin(group, joined)] = group[a + k]
        return out

    def run(batches):
        now, parts, held, last = None, [], 0, None
        for batch in batches:
            keys, out = batch.column(0).to_numpy(), []
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for at, end in zip(edges, edges[1:]):
                if keys[at] != now:
                    out += near(parts) if held > 1 else []
                    now, parts, held, last = keys[at], [], 0, None
                parts.append(batch.slice(at, end - at))
                held += end - at
                if held > most or last is not None:
                    rows = pa.Table.from_batches(parts)
                    i, n = (np.append(v, rows.column(c).to_numpy()) for v, c in zip(last or ([], []), (1, 2)))
                    i, n = i.astype(np.int64), n.astype(np.int64)
                    k = np.flatnonzero(100 * n[:-1] >= percent * n[1:])
                    out.append((i[k], i[k + 1]))
                    parts, held, last = [], 0, (i[-1:], n[-1:])
            if out:
                yield _batch(*(np.concatenate(v) for v in zip(*out)))
        if held > 1:
            out = near(parts)
            if out:
                yield _batch(*(np.concatenate(v) for v in zip(*out)))

    return run


def _batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])


class PrefixTree:
    """Sets in one global order as a prefix tree, an unbranched stretch of at most `stretch` ranks a node, level by level."""

    def __init__(self, sets: list[np.ndarray], stretch: int = 32):
        """sets: ranks in ascending order; low ranks are the rarest, where sets that aren't similar differ first."""
        n = len(sets)
        self.order = np.array(sorted(range(n), key=lambda i: sets[i].astype(">i4").tobytes()), np.int64)
        size = np.array([len(sets[i]) for i in self.order], np.int64)
        shared = np.zeros(n + 1, np.int64)  # depth that a path has in common with the one before
        for k in range(1, n):
            x, y = sets[self.order[k - 1]], sets[self.order[k]]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared[k] = differ[0] if len(differ) else m
        spans, open_ = [(k, k + 1, int(size[k])) for k in range(n)], []
        for k in range(1, n + 1):  # where paths branch: the widest runs of paths that share a depth
            depth, left = int(shared[k]) if k < n else -1, k - 1
            while open_ and open_[-1][0] > depth:
                own, left = open_.pop()
                spans.append((left, k, own))
            if depth >= 0 and (not open_ or open_[-1][0] < depth):
                open_.append((depth, left))
        pieces = [(a, b, d) for a, b, end in spans for d in [*range(int(max(shared[a], shared[b])) + stretch, end, stretch), end]]
        nodes = sorted(pieces, key=lambda s: (s[0], -s[1], s[2]))
        level, parent, path = [], [], []
        for i, (left, right, _) in enumerate(nodes):
            while path and nodes[path[-1]][1] < right or path and nodes[path[-1]][1] <= left:
                path.pop()
            parent.append(path[-1] if path else -1)
            level.append(level[path[-1]] + 1 if path else 0)
            path.append(i)
        by_level = np.argsort(level, kind="stable")
        place = np.empty(len(nodes) + 1, np.int64)
        place[by_level], place[-1] = np.arange(len(nodes)), len(nodes)
        table = np.array(nodes, np.int64)[by_level]
        self.left, self.right, self.depth = table.T
        self.parent = place[np.array(parent, np.int64)[by_level]]
        begin = np.append(self.depth, 0)[self.parent]
        self.cut = np.append(0, np.cumsum(self.depth - begin))
        self.flat = np.concatenate([sets[self.order[k]][b:e] for k, b, e in zip(self.left.tolist(), begin.tolist(), self.depth.tolist())])
        self.small, self.large = np.minimum.reduceat(np.append(size, 0), np.stack([self.left, self.right], 1).ravel())[::2], np.maximum.reduceat(np.append(size, 0), np.stack([self.left, self.right], 1).ravel())[::2]
        self.levels = np.append(np.flatnonzero(np.diff(np.array(level)[by_level], prepend=-1)), len(nodes)).tolist()
        self.leaves = np.flatnonzero((self.right - self.left == 1) & (self.depth == size[self.left]))

    def similar(self, n: int, inside: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Wanted sets that are similar to a set of n elements, whose ranks `inside` marks.

        The overlap of a stretch is counted once for all paths through it. A node, and with it all below, is left as soon
        as no wanted set is below, or what remains of the longest path can't reach the overlap that the shortest needs.
        """
        below = np.append(0, np.cumsum(wanted[self.order]))
        need = -(-percent * (n + self.small) // (100 + percent))
        live = np.append((below[self.right] > below[self.left]) & (need <= np.minimum(n, self.large)), True)
        overlap = np.zeros(len(live), np.int64)
        for a, b in zip(self.levels, self.levels[1:]):
            on = a + np.flatnonzero(live[a:b] & live[self.parent[a:b]])
            live[a:b] = False
            if not len(on):
                break
            size = self.cut[on + 1] - self.cut[on]
            at = np.repeat(self.cut[on] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            counts = np.append(0, np.cumsum(inside[self.flat[at]]))
            ends = np.cumsum(size)
            own = overlap[self.parent[on]] + counts[ends] - counts[ends - size]
            overlap[on] = own
            live[on] = own + np.minimum(n - own, self.large[on] - self.depth[on]) >= need[on]
        found = self.leaves[live[self.leaves]]
        sets = self.order[self.left[found[overlap[found] >= need[found]]]]
        return sets[wanted[sets]]


def linked(ids: np.ndarray, label: np.ndarray, side: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, percent: int, weights: np.ndarray) -> list[tuple[int, int]]:
    """Links that join sets of different labels, one for each two labels that come together: pairs of ids.

    Sets of one label are in one group already and sets of side 0 are not compared with each other; each other two sets
    are compared once at most, and not at all once they are in one group.
    """
    n = len(ids)
    if n < 2:
        return []
    codes, unique = pd.factorize(hashes)
    rank = np.empty(len(unique), np.int64)
    rank[np.lexsort((unique, weights[_cell(unique)]))] = np.arange(len(unique))  # as the global order has them
    ranks = rank[codes].astype(np.int32)
    sets = [np.sort(ranks[offsets[i] : offsets[i + 1]]) for i in range(n)]
    tree, inside = PrefixTree(sets), np.zeros(len(unique), np.int64)
    own, first = np.unique(label, return_index=True)
    group = np.searchsorted(own, label)
    size = np.array([len(s) for s in sets])
    left, out = size > 0, []  # left: not yet had their turn
    for x in np.lexsort((np.arange(n), size)).tolist():
        left[x] = False
        wanted = left & (group != group[x])
        if side[x] == 0:
            wanted &= side != 0
        if not size[x] or not wanted.any():
            continue
        inside[sets[x]] = 1
        found = tree.similar(int(size[x]), inside, wanted, percent)
        inside[sets[x]] = 0
        if len(found):
            joined, at = np.unique(group[found], return_index=True)
            out += [(int(ids[x]), int(ids[f])) for f in found[at].tolist()]
            group[np.isin(group, joined)] = group[x]
    return out


def _verified(size: int, percent: int, weights):
    """Links inside each block of rows (key, side, label, id, text), which come sorted by key; a block's texts become sets a slice at a time."""

    def links(parts):
        rows = pa.Table.from_batches(parts)
        sets = [shingle_sets(*text_bytes(cut.column(4)), size) for part in parts for cut in slices(part, "text")]
        hashes = np.concatenate([h for h, _ in sets])
        offsets = np.append(0, np.cumsum(np.concatenate([np.diff(o) for _, o in sets])))
        out = linked(*(rows.column(c).to_numpy() for c in ("id", "label", "side")), hashes, offsets, percent, weights.value)
        return [_batch(*(np.array(v, np.int64) for v in zip(*out)))] if out else []

    def run(batches):
        now, parts = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for at, end in zip(edges, edges[1:]):
                if keys[at] != now and parts:
                    yield from links(parts)
                    parts = []
                now = keys[at]
                parts.append(batch.slice(at, end - at))
        if parts:
            yield from links(parts)

    return run


def _cut(scratch: Scratch, members: DataFrame, seen: DataFrame, block_shingles: int, percent: int) -> DataFrame:
    """Members (node, block, n) with blocks of more than block_shingles cut into what may link by histogram.

    Chains bring sets together by one token and their sizes alone. Their texts would be sent to each other part by part;
    histograms take a twentieth of that. Any two parts of a block meet, so similar sets stay in one block.
    """
    large = members.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("sets"), F.sum("n").alias("n")).where((F.col("n") > block_shingles) & (F.col("sets") <= _PART * _PARTS)).select("b", F.ceil(F.col("sets") / _PART).cast("int").alias("parts"))
    large = scratch.table("large", large)
    if large.isEmpty():
        return members
    own = members.drop("n").join(large, F.col("block") == F.col("b")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("node", F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("token"))
    sent = seen.join(own, F.col("id") == F.col("node")).select("token", "id", "n", "near0", "near1").repartition("token").sortWithinPartitions("token", "n", "id")
    near = scratch.table("near2", sent.mapInArrow(_close_members(percent, 1 << 40), "src long, dst long").distinct())
    labels = connected_components(near, owner=scratch, at_driver=_AT_DRIVER).select(F.col("node").alias("l"), "component")
    whole = members.join(large, F.col("block") == F.col("b"), "left_anti")
    cut = members.join(large, F.col("block") == F.col("b"), "left_semi").join(labels, F.col("node") == F.col("l"))
    return scratch.table("cut", whole.unionByName(cut.select("node", F.col("component").alias("block"), "n")))


def _labelled(scratch: Scratch, name: str, members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the smallest node that the links join them with, as label."""
    labels = connected_components(links, owner=scratch, at_driver=_AT_DRIVER).select(F.col("node").alias("l"), F.col("component").alias("c"))
    return scratch.table(name, members.join(labels, F.col("node") == F.col("l"), "left").withColumn("label", F.coalesce("c", "node")).drop("l", "c"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block_shingles: int = 1 << 18, few: int = 24, most: int = 1 << 14) -> DataFrame:
    """Groups documents whose sets of word shingles link: 100 * intersection >= percent * union. (id, n_shingles, component)

    Equal sets are one class, found by two 64-bit sums over the set. All shingles stand in one global order: by the weight
    of the cell that they are counted in, rare ones first, then by hash. Sets are routed by their prefix tokens in that
    order, one of which two similar sets must share. Tokens of up to `few` sets try their pairs by size, place and
    histogram (bounds, not guesses); so do those of a commoner token, in one task, as long as they don't make one group;
    only tokens of more than `most` sets, and heavy ones in salted parts, chain their sets by size. The components of
    these candidates are blocks. A block's sets form a prefix tree in the global order, whose traversal
    shares overlaps along common paths and leaves a path by the bound on what remains; sets that are in one group
    already are not compared. A block of more than block_shingles is cut by histograms first, and then into chunks: each meets the first one, and
    what has not come together by then meets all others in parts, so no group has to fit in one task, and a
    group of copies is sent twice at most. component is the smallest id reachable by links.

    Null texts, and texts without words, have an empty set and link with nothing. Rows that repeat an id are one node.
    A null id links with nothing and has a null component. Other columns are ignored; an empty table gives no rows.
    Shingles are told by 64-bit hashes: two sets of a and b shingles are compared wrongly with a chance of about a * b / 2**64.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = scratch.table("meta", rows.mapInArrow(_meta(shingle, percent), _META))
    meta = both.where("kind = 0").drop("kind")
    weight = np.zeros(_CELLS, np.uint8)
    cells = both.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as cells at most
    weight[cells.column("id").to_numpy()] = np.floor(np.log2(cells.column("n").to_numpy())).astype(np.uint8) + 1
    weights = spark.sparkContext.broadcast(weight)
    known = meta.where("n > 0 and id is not null")
    classes = scratch.table("classes", known.groupBy(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("c3")).agg(F.min("id").alias("lead"), F.count("*").alias("copies")))
    of_class = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") == F.col("c3"))
    repeated = known.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("times")).where("times > 1")
    copies = known.join(classes.where("copies > 1"), of_class).where("id <> lead").select("id").join(repeated, F.col("id") == F.col("again"), "left_anti")
    tokens = meta.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    twins = spark.sparkContext.broadcast(_twins(classes))
    marks, bits = repeated_tokens(scratch, rows, shingle, percent, weights, twins, int(tokens))
    bits = spark.sparkContext.broadcast(bits)
    routed = rows.mapInArrow(_tokens(shingle, percent, weights, twins, marks, bits), _TOKEN).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "id")
    met = scratch.table("met", routed.mapInArrow(_meeting(few, percent, True), _MET))
    seen = known.select("id", F.col("n").cast("int").alias("n"), "near0", "near1").join(copies, "id", "left_anti")
    pairs = scratch.table("pairs", met.where("kind = 0").select("id", "n", "other", "other_n").distinct())
    pairs = pairs.join(seen, ["id", "n"]).withColumnsRenamed({"near0": "a0", "near1": "a1"})
    other = seen.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("near0").alias("b0"), F.col("near1").alias("b1"))
    pairs = pairs.join(other, ["other", "other_n"])
    link = "src long, dst long"
    chains = met.where("kind = 1").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    members = met.where("kind = 3")
    # sets that all have the same token before this one meet under that one too
    first = members.groupBy("token").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least <> most or least = 0").select("token")
    members = scratch.table("first", members.join(first, "token", "left_semi").select("token", "id", "n"))
    members = members.join(seen, ["id", "n"]).select("token", "id", "n", "near0", "near1")
    members = members.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(_close_members(percent, most), link)
    salted = met.where("kind = 2").select("token", "id", "n", "other_n").repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(_over_salts(percent), link)
    near = scratch.table("near", pairs.select("id", "n", "a0", "a1", "other", "other_n", "b0", "b1").mapInArrow(_close_pairs(percent), link).unionByName(members).unionByName(chains).unionByName(salted).distinct())
    blocks = scratch.table("blocks", connected_components(near, owner=scratch, at_driver=_AT_DRIVER))
    leads = classes.groupBy(F.col("lead").alias("node")).agg(F.max("c3").alias("n"))  # an id that repeats may lead several classes
    members = scratch.table("members", blocks.join(leads, "node").select("node", F.col("component").alias("block"), "n"))
    members = _cut(scratch, members, seen, block_shingles, percent)
    sizes = members.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("sets"), F.ceil(F.sum("n") / block_shingles).cast("int").alias("chunks")).where("sets > 1")
    placed = scratch.table("placed", members.join(sizes, F.col("block") == F.col("b")).select("node", "block", "n", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")))
    key = lambda *parts: F.concat_ws("/", *parts)

    def links(name: str, sent: DataFrame) -> DataFrame:
        """Links of what is sent (node, key, side, label): every text goes to its keys, each of which is one task's work."""
        texts = rows.join(told(sent.select("node").distinct()), F.col("id") == F.col("node"), "left_semi")
        grouped = texts.join(sent, F.col("id") == F.col("node")).select("key", "side", "label", "id", "text").repartition("key").sortWithinPartitions("key", "id")
        return scratch.table(name, grouped.mapInArrow(_verified(shingle, percent, weights), link))

    own = placed.select("node", key("block", "chunk").alias("key"), F.when(F.col("chunk") == 0, 1).otherwise(2).alias("side"), F.col("node").alias("label"))
    hub = placed.where("chunk = 0 and chunks > 1").select("node", "block", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("chunk")).select("node", key("block", "chunk").alias("key"), F.lit(0).alias("side"), F.col("node").alias("label"))
    found = links("links", scratch.table("sent", own.unionByName(hub)))
    large = placed.where("chunks > 1")
    if not large.isEmpty():
        labelled = _labelled(scratch, "labelled", large, found)
        groups = labelled.groupBy("block", "label").agg(F.sum("n").alias("n"))
        top = groups.groupBy(F.col("block").alias("b")).agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
        apart = scratch.table("apart", labelled.join(top, F.col("block") == F.col("b")).drop("b", "groups"))
        rest = apart.where("label <> top")
        parts = rest.groupBy(F.col("block").alias("b")).agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"))
        there = apart.join(parts, F.col("block") == F.col("b"))
        stay = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", key("block", "chunk", "part").alias("key"), F.lit(1).alias("side"), "label")
        come = there.where("label <> top").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", key("block", "chunk", "part").alias("key"), F.lit(2).alias("side"), "label")
        if not rest.isEmpty():
            found = found.unionByName(links("more", scratch.table("sent2", stay.unionByName(come).groupBy("node", "key", "label").agg(F.max("side").alias("side")))))
    bridges = known.join(repeated, F.col("id") == F.col("again"), "left_semi").join(classes, of_class).select(F.col("id").alias("src"), F.col("lead").alias("dst"))
    labels = scratch.table("labels", connected_components(found.unionByName(bridges), owner=scratch, at_driver=_AT_DRIVER).select(F.col("node").alias("l"), F.col("component").alias("c")))
    scratch.keep("meta", "classes", "labels")
    joined = meta.join(classes.where("copies > 1"), of_class & F.col("id").isNotNull(), "left").withColumn("lead", F.coalesce("lead", "id")).join(labels, F.col("lead") == F.col("l"), "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.coalesce("c", "lead").alias("component"))
