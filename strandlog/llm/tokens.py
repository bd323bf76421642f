"""Whole texts to byte-level BPE ids, a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .shared import eights, same_spans, span_hashes

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_APOSTROPHE = ord("'")


def _classes() -> np.ndarray:
    """The class of every code point, as the tokenizer's split pattern sees it."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, codes))
    at = np.array(codes)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[at[m.start() : m.end()]] = kind
    return table


def _merger(path: str):
    """A faster merger of single pieces where the file's merges stand in the order of their ids, else None."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    # the byte-level alphabet: printable Latin-1 stands for itself, other bytes from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain)) | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    made = [ids["".join(m)] for m in merges]
    if made != sorted(made) or any(c not in letters for m in merges for x in m for c in x):
        return None
    import tiktoken

    whole = {"".join(m) for m in merges} | set(letters)
    ranks = {bytes(letters[c] for c in word): ids[word] for word in whole}
    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordIds:
    """Ids of texts under a byte-level BPE vocabulary, equal to those of its tokenizer.

    Texts are cut into the pieces of the split pattern with array operations; a piece's ids are worked out
    once by the tokenizer and kept by the piece's bytes while the memory lasts. Equal pieces of a slice are found
    by hash and then compared byte by byte. Texts that hold a special token of the vocabulary go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes, self.most = _classes(), most
        self.merge = _merger(path)
        self._reset()

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        if self.merge:
            return [self.merge(p) for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _reset(self):
        self.known: dict[bytes, int] = {}
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _byte_classes(self, raw: np.ndarray) -> np.ndarray:
        kind = self.classes[raw]  # right for ASCII
        for at in (np.flatnonzero(raw >= 0xC0),):
            b = raw[at].astype(np.int64)
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            code = b & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
            for k in (1, 2, 3):
                more = size > k
                code[more] = (code[more] << 6) | (raw[at[more] + k] & 0x3F)
            own = self.classes[code]
            kind[at] = own
            for k in (1, 2, 3):
                more = size > k
                kind[at[more] + k] = own[more]
        return kind

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the split pattern begin."""
        n = len(raw)
        kind = self._byte_classes(raw)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        run[n] = True
        start = run[:n].copy()
        # the last white-space character before a word: a space joins the word, another stands alone
        space = kind == _SPACE
        ends = np.flatnonzero(space & run[1:] & ~first[1:])
        blank = raw[ends] == 32
        start[ends[blank]] = True
        start[ends[blank] + 1] = False
        lone = ends[~blank]
        while len(lone) and (cont := (raw[lone] & 0xC0) == 0x80).any():
            lone = np.where(cont, lone - 1, lone)
        start[lone] = True
        # contractions: an apostrophe that begins a piece of its own before certain letters
        q = np.flatnonzero((raw == _APOSTROPHE) & run[:n] & run[1:] & start)
        q = q[(q + 1 < n)]
        q = q[(kind[q + 1] == _LETTER) & ~first[q + 1]]
        if len(q):
            a = raw[q + 1]
            b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], raw[np.minimum(q + 2, n - 1)], 0)
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for which, size in ((one, 2), (two, 3)):
                at = q[which]
                start[at + 1] = False
                after = at + size
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets into them)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin = self.starts(raw, offsets)
        end = np.append(begin[1:], len(raw))
        at8, data = eights(raw), raw.tobytes()
        code, unique = pd.factorize(span_hashes(at8, begin, end))
        where = np.empty(len(unique), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        size = end - begin
        same = (size == size[where][code]) & same_spans(at8, begin, begin[where][code], np.minimum(size, size[where][code]))
        if not same.all():  # pieces that only share their hash are told apart by their bytes
            code, _ = pd.factorize(np.array([data[b:e] for b, e in zip(begin.tolist(), end.tolist())], object))
            where = np.empty(code.max() + 1, np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
        keys = [data[b:e] for b, e in zip(begin[where].tolist(), end[where].tolist())]
        if len(self.known) + len(keys) > self.most:
            self._reset()
        slot = np.array([self.known.get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            got = self._pieces([keys[m] for m in missing.tolist()])
            size = np.array([len(g) for g in got], np.int64)
            slot[missing] = len(self.offsets) - 1 + np.arange(len(missing))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
            self.known.update(zip([keys[m] for m in missing.tolist()], slot[missing].tolist()))
        piece = slot[code]
        size = np.diff(self.offsets)[piece]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.offsets[piece] - (ends - size), size) + np.arange(ends[-1])]
        texts = np.append(0, ends)[np.searchsorted(begin, offsets)]
        return self._with_special(raw, offsets, ids, texts)

    def _with_special(self, raw, offsets, ids, texts):
        data = raw.tobytes()
        odd = set()
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = data.find(s, at + 1)
        if not odd:
            return ids, texts
        parts = [ids[texts[i] : texts[i + 1]] for i in range(len(texts) - 1)]
        for i in odd:
            parts[i] = np.array(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
