"""Words of whole texts as hashes, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .shared import eights, sequence_hashes, span_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Letters and digits of ASCII and every byte of a longer character: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

#: Everything but white space: [^\x20\x09-\x0D].
UNSPACED = np.ones(256, bool)
UNSPACED[0x20] = UNSPACED[0x09:0x0E] = False


class Words:
    """The words of a run of texts: lower-cased bytes, (begin, end) and hash of each word, first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.raw = LOWER[raw]
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[self.raw]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = span_hashes(eights(self.raw), self.begin, self.end)
        self.first = np.searchsorted(self.begin, offsets)

    def runs(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of size words (64 at most) from each start."""
        return sequence_hashes(self.hash, start, size)

    def texts(self, start: int, size: int) -> list[bytes]:
        return [self.raw[b:e].tobytes() for b, e in zip(self.begin[start : start + size], self.end[start : start + size])]
