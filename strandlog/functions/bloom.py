"""Bloom filters over strings, built in the cluster."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import InvalidOptions

#: Offset basis and prime of the 64-bit FNV hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_WORD = 64
_PART = 1 << 20


def fnv(keys: list[bytes], xor_first: bool) -> np.ndarray:
    """FNV-1a (xor first) or FNV-1 hashes of many keys at once, whatever their lengths: array operations over all bytes.

    A step's xor changes the low byte alone, and low bytes depend on low bytes alone. Once these are known, a bit at a
    time as running xors, the xor is the addition of a known number, and a hash a sum of such numbers times powers of the prime.
    """
    size = np.array([len(k) for k in keys], np.int64)
    flat, out = np.frombuffer(b"".join(keys), np.uint8), np.empty(len(keys), np.uint64)
    ends = np.cumsum(size)
    at = 0
    while at < len(keys):  # about a megabyte at a time, one key at least
        begin = int(ends[at] - size[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + _PART, "right")))
        out[at:stop] = _fnv(flat[begin : int(ends[stop - 1])], size[at:stop], xor_first)
        at = stop
    return out


def _fnv(flat: np.ndarray, size: np.ndarray, xor_first: bool) -> np.ndarray:
    out, some = np.empty(len(size), np.uint64), size > 0
    out[~some] = FNV_BASIS
    if not some.any():
        return out
    many = size[some]
    start, low, step = np.cumsum(many) - many, FNV_BASIS & 255, FNV_PRIME & 255
    now = np.zeros(len(flat), np.uint8)  # the low byte that the prime is multiplied with at each place, as far as its bits are known
    for bit in range(8):
        one = np.uint8(1 << bit)
        # what the known lower bits of a place give this bit of the next product; this bit itself passes, as the prime is odd
        carry = (now * np.uint8(step)) & one
        change = flat & one
        if xor_first:  # now = (the product before) ^ byte
            change[1:] ^= carry[:-1]
        else:  # now = the product before ^ the byte before
            change[1:] = change[:-1] ^ carry[:-1]
        change[start] = (flat[start] & one if xor_first else np.uint8(0)) ^ np.uint8(low & (1 << bit))
        run = np.bitwise_xor.accumulate(change)
        before = np.append(np.uint8(0), run[start[1:] - 1])
        now |= run ^ np.repeat(before, many)
    left = np.repeat(start + many, many) - np.arange(len(flat))  # steps from here to the key's end
    if xor_first:  # h ^ byte = h + (low after - low before)
        added = now.astype(np.int64) - (now ^ flat)
    else:  # (h * prime) ^ byte
        product = now * np.uint8(step)
        added, left = (product ^ flat).astype(np.int64) - product, left - 1
    powers = np.ones(int(many.max()) + 1, np.uint64)
    powers[1:] = FNV_PRIME
    powers = np.multiply.accumulate(powers)
    out[some] = np.add.reduceat(added.view(np.uint64) * powers[left], start) + np.uint64(FNV_BASIS) * powers[many]
    return out


def best_size(expected: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for that many keys at that rate of false answers: bits in whole words, one hash at least."""
    if expected <= 0 or not 0 < rate < 1:
        raise InvalidOptions("a Bloom filter needs expected keys and a rate between 0 and 1")
    bits = -(-math.ceil(-expected * math.log(rate) / math.log(2) ** 2) // _WORD) * _WORD
    return bits, max(1, round(bits / expected * math.log(2)))


class BloomFilter:
    """Says of a key that it isn't there, or that it may be. The empty key is never there."""

    def __init__(self, bits: int, hashes: int, words: np.ndarray | None = None, count: int = 0):
        if bits <= 0 or hashes <= 0:
            raise InvalidOptions("a Bloom filter needs bits and hashes")
        self.bits, self.hashes, self.count = bits, hashes, count
        self.words = np.zeros(-(-bits // _WORD), np.uint64) if words is None else words

    @classmethod
    def sized(cls, expected: int, rate: float) -> BloomFilter:
        return cls(*best_size(expected, rate))

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The bits of each key: (h1 + i * h2 + i * i) modulo the bits, for each hash i."""
        one, two = fnv(keys, True), fnv(keys, False)
        i = np.arange(self.hashes, dtype=np.uint64)
        return (one[:, None] + i * two[:, None] + i * i) % np.uint64(self.bits)

    def add(self, keys: Iterable[str]) -> None:
        own = [k.encode() for k in keys if k]
        at = self.places(own).ravel()
        np.bitwise_or.at(self.words, (at // _WORD).astype(np.int64), np.uint64(1) << (at % np.uint64(_WORD)))
        self.count += len(own)

    def may_contain(self, key: str) -> bool:
        return bool(self.may_contain_each([key])[0])

    def may_contain_each(self, keys: list[str]) -> np.ndarray:
        """may_contain of many keys at once."""
        own = [k.encode() for k in keys]
        at = self.places(own)
        return ((self.words[(at // _WORD).astype(np.int64)] >> (at % np.uint64(_WORD))) & np.uint64(1)).all(1) & np.array([len(k) > 0 for k in own], bool)

    def reset(self) -> None:
        self.words[:], self.count = 0, 0

    def false_positive_rate(self) -> float:
        """What may be expected of the keys added so far."""
        return (1 - math.exp(-self.hashes * self.count / self.bits)) ** self.hashes

    def text(self) -> str:
        return json.dumps({"bits": self.bits, "hashes": self.hashes, "count": self.count, "words": base64.b64encode(self.words.astype("<u8").tobytes()).decode()})

    @classmethod
    def of(cls, text: str) -> BloomFilter:
        raw = json.loads(text)
        return cls(raw["bits"], raw["hashes"], np.frombuffer(base64.b64decode(raw["words"]), "<u8").astype(np.uint64), raw["count"])


def build_bloom(keys: DataFrame, column: str, rate: float = 0.01, most_bits: int = 1 << 23) -> BloomFilter:
    """A filter over the different keys of a table: tasks send the words they set, which meet by bit_or.

    most_bits bounds what comes to the driver (a megabyte); a table of more keys gets a less sharp filter, never a wrong one.
    """
    different = keys.select(F.col(column).alias("k")).where("k <> ''").distinct()
    n = different.count()
    bits, hashes = best_size(max(1, n), rate)
    out = BloomFilter(min(bits, most_bits), hashes, count=n)
    if not n:
        return out
    empty = BloomFilter(out.bits, out.hashes)

    def run(batches):
        import pyarrow as pa

        own = BloomFilter(empty.bits, empty.hashes)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], names=["at", "word"])

    words = different.mapInArrow(run, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    out.words[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out
