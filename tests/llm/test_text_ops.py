"""Packing, language identification, decontamination, near duplicates, substrings and the pipeline against plain versions."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlog.llm import decontaminate, jaccard, langid, packing, substrings
from strandlog.llm.components import connected_components
from strandlog.llm.shared import eights, same_spans, sequence_hashes, slices, span_hashes, text_bytes
from strandlog.llm.tokens import WordIds

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words(n, seed, most=500):
    draw = random.Random(seed)
    return [f"w{draw.randrange(most)}" for _ in range(n)]


def thue_morse(n):
    """The word of n letters and its complement, which collide under every polynomial modulo 2**64 from 1024 letters on."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_and_slices():
    at8 = eights(np.frombuffer(b"abcabcabc" * 50, np.uint8))
    h = span_hashes(at8, np.arange(0, 400), np.arange(50, 450))
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3
    draw = random.Random(9)
    parts = ["", "a", "a\0", "\0", "aa", *thue_morse(512), *thue_morse(4096), *["".join(draw.choice("ab\0") for _ in range(draw.choice([3, 8, 9, 16, 31, 32, 33, 40, 41, 200]))) for _ in range(400)]]
    raw, offsets = text_bytes(pa.array([p + "x" for p in parts] * 2))
    begin, end = offsets[:-1], offsets[1:] - 1
    h = span_hashes(eights(raw), begin, end).tolist()
    assert len(set(h)) == len(set(parts)) and h[: len(parts)] == h[len(parts) :] and h != span_hashes(eights(raw), begin, end, 1).tolist()
    pairs = [(i, j) for i in range(len(parts)) for j in (draw.randrange(2 * len(parts)), i + len(parts)) if len(parts[i]) == len((parts * 2)[j])]
    a, b = (np.array(x) for x in zip(*pairs))
    assert same_spans(eights(raw), begin[a], begin[b], end[a] - begin[a]).tolist() == [parts[i] == (parts * 2)[j] for i, j in pairs]
    values = np.array([5, 6, 5, 6, 7], np.uint64)
    s = sequence_hashes(values, np.array([0, 2, 0, 1]), np.array([2, 2, 1, 2]))
    assert s[0] == s[1] and len(set(s.tolist())) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "", "c", "d" * 9])], names=["i", "text"])
    parts = list(slices(batch, "text", 20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6)) and len(parts) == 3
    raw, offsets = text_bytes(batch.column(1).slice(2))
    assert raw.tobytes() == b"b" * 100 + b"c" + b"d" * 9 and offsets.tolist() == [0, 100, 100, 101, 110]


def test_ids_equal_the_tokenizer_s():
    draw = random.Random(1)
    bits = ["a", "s", "'", "'s", "'re", " ", "\n", "  ", "é", "1", "!", "<|endoftext|>", "　", "漢", "'ll", "\t", "😀", "t", "'T", "\r\n", "½", "x'd", "\0", "\x85", "é"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["", "word " * 3000, "don't won't I'll we've they're it's I'm he'd"]
    ids, offsets = WordIds(VOCABULARY, most=50).encode(*text_bytes(pa.array(texts)))
    want = [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == want


def test_shortest_pack_first_places_all():
    for seed in range(20):
        draw = random.Random(seed)
        h = {draw.randint(1, 64): draw.randint(1, 50) for _ in range(30)}
        packs = packing.shortest_pack_first(h, 64)
        placed = {}
        for lengths, count in packs:
            assert sum(lengths) <= 64
            for x in lengths:
                placed[x] = placed.get(x, 0) + count
        assert placed == h
    assert packing.shortest_pack_first({}, 64) == []


def test_packing_covers_every_id(spark):
    rows = [(i, " ".join(words(random.Random(i).choice([3, 40, 900, 2500]), i)), 0) for i in range(60)] + [(70, None, 0), (71, "", 0), (None, "x", 0), (5, "again", 0), (5, "again", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int, length int").repartition(5)
    got = packing.pack_documents(docs, VOCABULARY, size=512).collect()
    t = Tokenizer.from_file(VOCABULARY)
    want = sorted([(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in rows], key=str)
    ids = {str((i, len(x))): x for i, x in want}
    pieces = {}
    for r in got:
        own = ids[str((r.doc_id, r.doc_tokens))][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *own)) == r.ids_crc32
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    padding = sum(512 - sum(x for _, x in p) for p in pieces.values())
    assert padding < 512 + 0.05 * sum(r.length for r in got)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def language_rows():
    draw = random.Random(2)
    parts = {"xx": ["the", "ing", "and", "tion", "wh"], "yy": ["ö", "ung", "sch", "keit", "der"], "zz": ["ção", "ñ", "os", "que", "la"]}
    return [(i, " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 80))), lang) for i in range(600) for lang in [draw.choice(sorted(parts))]]


def test_languages(spark):
    rows = language_rows() + [(900, None, "xx"), (901, "", "xx"), (902, "123 !? 4", None), (903, "the and the", None), (904, "é", "yy"), (1, "the", "xx"), (None, "schung der", "yy")]
    docs = spark.createDataFrame([(i, t, lang, "a") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs, F.coalesce(~held, F.lit(False)))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    out = [(r.lang, r.lang_pred) for r in got if r.lang and r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].lang_score == 0 and by[i].lang_rejected for i in (900, 901, 902)) and by[903].lang_pred == "xx"
    assert all(0 <= r.lang_score <= 1 for r in got) and sum(r.lang_rejected for r in got) < 0.02 * len(got) + 4
    same = langid.identify(docs.withColumn("lang", F.lit("other")).withColumn("doc_id", F.col("doc_id") + 7), model)
    assert sorted(r.lang_pred for r in same.collect()) == sorted(r.lang_pred for r in got)
    assert langid.train(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs.limit(5), None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def plain_subwords(text):
    """Counted subwords by order and bucket, from the definition: byte n-grams of the folded text between two spaces."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    own = bytes([32, *map(fold, text.encode()), 32])
    out = []
    for k in range(len(own)):
        if (own + b" ")[k : k + 2] != b"  ":
            for o, n in enumerate((2, 3, 4)):
                gram = (own + b" " * 8)[k : k + n]
                out.append((o, (int.from_bytes(gram, "little") * 0x9E3779B1 % (1 << 32)) >> 18))
    return out


def test_predictions_equal_a_plain_version():
    rows = language_rows()[:200]
    model = langid.fit([t for _, t, _ in rows], [lang for *_, lang in rows])
    texts = [t for _, t, _ in language_rows()[200:260]] + ["a", "É x", "the  ing"]
    best, score, _ = model.predict(*text_bytes(pa.array(texts)))
    for text, b, s in zip(texts, best, score):
        grams = plain_subwords(text)
        z = np.array([sum(float(model.scores[o, k, c]) for o, k in grams) / len(grams) + float(model.bias[c]) for c in range(len(model.languages))]) / model.temperature
        p = np.exp(z - z.max())
        assert b == p.argmax() and abs(s - p.max() / p.sum()) < 1e-4


def test_a_step_of_descent_equals_a_plain_one():
    rng = np.random.default_rng(1)
    embed, weight, bias = rng.normal(size=(30, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    size, y = np.array([2, 1, 3]), np.array([0, 2, 2])
    flat = rng.integers(0, 30, (2, 6))
    new = [v.copy() for v in (embed, weight, bias)]
    langid.sgd_step(*new, flat, size, y, 0.5, 2 / 3)

    def loss(e, w, b):
        total, at = 0.0, 0
        for n, c in zip(size, y):
            z = e[flat[:, at : at + n].ravel()].mean(0) @ w + b
            total += np.log(np.exp(z).sum()) - z[c]
            at += n
        return total / len(y)

    for k, (old, now, rate) in enumerate(zip((embed, weight, bias), new, (1.0, 0.5, 0.5))):
        for at in np.ndindex(old.shape):
            moved = [v.copy() for v in (embed, weight, bias)]
            moved[k][at] += 1e-6
            assert abs((old[at] - now[at]) / rate - (loss(*moved) - loss(embed, weight, bias)) / 1e-6) < 1e-4


def test_foreign_text_and_junk_are_rejected(spark):
    draw = random.Random(11)
    parts = ["qx", "zw", "vv", "jk", "xu"]
    foreign = [" ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(60)) for _ in range(50)]
    junk = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(50)]
    known = language_rows()
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in known], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    other = spark.createDataFrame([(t,) for t in foreign + junk], "text string")
    assert langid.identify(other, model).where("lang_rejected").count() >= 95
    assert langid.identify(docs, model).where("lang_rejected").count() <= 6


def test_rows_without_ids_are_drawn_like_others(spark):
    """A flood of rows without an id, of one language, neither crowds the others out nor passes the bound."""
    rows = [(None, f"the and the ing {i} tion", "xx") for i in range(400)] + [(i, f"schung der ung {i}", "yy") for i in range(50)] + [(None, "only once", "zz"), (None, "only once", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    real, langid.fit = langid.fit, lambda texts, labels, **_: seen.append(list(zip(labels, texts)))
    try:
        langid.train(docs, F.lit(True), per_language=60)
        langid.train(docs, F.lit(True), most_bytes=300)
    finally:
        langid.fit = real
    count = lambda x: {lang: sum(a == lang for a, _ in x) for lang in ("xx", "yy", "zz")}
    assert count(seen[0]) == {"xx": 60, "yy": 50, "zz": 1} and all(0 < n <= 6 for n in count(seen[1]).values())
    assert sum(len(t.encode()) for _, t in seen[1]) <= 300 and {t for _, t in seen[0]} <= {t for _, t, _ in rows}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_contamination(docs, items, window):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for ws, ids in wins.items():
            for k in range(len(w) - len(ws) + 1):
                if tuple(w[k : k + len(ws)]) == ws:
                    hit |= set(range(k, k + len(ws)))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_contamination(spark):
    items = [(i, " ".join(words(random.Random(i).choice([2, 4, 9, 30]), 100 + i, 40))) for i in range(25)] + [(25, None), (26, "!?"), (27, "W1 w2"), (3, "other text of three"), (28, "é ü w9")]
    docs = [(i, " ".join(words(random.Random(i).choice([0, 3, 60, 400]), i, 40)).replace("w1", "W1")) for i in range(120)]
    docs += [(200 + i, " ".join(words(20, i)) + ". " + (items[i][1] or "").upper() + "!\n" + " ".join(words(30, i + 1))) for i in range(29)] + [(None, items[0][1]), (1, docs[1][1]), (300, None), (301, "x\0w1-w2"), (302, "É ü w9")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame([*items, (None, docs[3][1])], "item_id long, text string")
    for window, block in ((5, 1 << 24), (5, 300), (2, 1 << 24)):
        got = decontaminate.contamination(d, b, window=window, block_bytes=block).collect()
        assert sorted([(r.doc_id, r.n_words, sum(h.stop - h.start for h in r.hits), list(r["items"])) for r in got], key=str) == plain_contamination(docs, items, window)
    assert {len(r.hits) for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}
    twins = thue_morse(1024)
    got = decontaminate.contamination(spark.createDataFrame([(1, twins[0]), (2, "x " + twins[1] + " y")], "doc_id long, text string"), spark.createDataFrame([(7, twins[1])], "item_id long, text string"))
    assert {(r.doc_id, tuple(r["items"])) for r in got.collect()} == {(1, ()), (2, (7,))}
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_the_index_keeps_its_bound():
    """25 times the items' text at most, 12 for words of five letters; equal windows are one entry."""
    for text, most in ((" ".join(random.Random(3).choice("abcdefgh") for _ in range(200_000)), 25), (" ".join(words(100_000, 4, 30_000)), 12), ("the same ten words over and over again without end " * 20_000, 12)):
        own = decontaminate.item_words(pa.array([text]))
        index = decontaminate.build_index(np.array([1]), own, {}, 10)
        assert index.nbytes() - index.sieve.nbytes <= most * len(text)
    assert len(index.start) == 10


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(sets[a][0]), top(sets[b][0])))
                root[q] = p
    return sorted([(i, len(shingles(t, n)), None if i is None else top(i)) for i, t in rows], key=str)


def near_rows(seed, families, copies):
    draw = random.Random(seed)
    rows = []
    passage = " ".join(words(60, 999))
    for f in range(families):
        base = words(draw.choice([1, 2, 3, 5, 7, 12, 40, 150]), seed * 1000 + f, 4000)
        for _ in range(draw.randint(1, copies)):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                k = draw.randrange(len(own) + 1)
                own[k : k + draw.choice([0, 1])] = [f"e{draw.randrange(10**6)}"] * draw.choice([0, 1])
            rows.append((len(rows) * 3 % 1009, " ".join(own) + (" " + passage if draw.random() < 0.2 else "")))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent,block,few", [(4, 85, 1 << 17, 24), (5, 80, 200, 3), (5, 80, 2000, 2), (3, 60, 1 << 19, 5)])
def test_jaccard_components(spark, n, percent, block, few):
    rows = near_rows(n, 40, 8) + [(2000, None), (2001, ""), (2002, " \t\n"), (None, "one two three four five"), (2003, "One  two three\tfour five"), (2004, "one two three four five"), (2005, "x"), (2006, "X"), (2007, "x x"), (2003, "six seven eight nine ten"), (2008, "six seven eight nine ten"), *[(2100 + i, x) for i, x in enumerate(thue_morse(1024))]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int").repartition(3)
    got = jaccard.jaccard_components(docs, shingle=n, percent=percent, block_shingles=block, few=few).collect()
    assert sorted([(r.id, r.n_shingles, r.component) for r in got], key=str) == plain_components(rows, n, percent)


def test_jaccard_of_empty_tables_and_lone_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f g h i j")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == [(1, 1, 1), (2, 3, 2)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def similar_sets(draw, percent):
    n = draw.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 20, 50, 200])
    x = {draw.getrandbits(64) for _ in range(n)}
    y = set(x)
    while True:
        z = set(y)
        if draw.random() < 0.5 and z:
            z.discard(draw.choice(sorted(z)))
        else:
            z.add(draw.getrandbits(64))
        if 100 * len(x & z) < percent * len(x | z):
            return sorted(x), sorted(y)
        y = z


def test_bounds_miss_no_similar_pair():
    draw = random.Random(4)
    weights = np.array([draw.choice([0, 0, 0, 3, 9]) for _ in range(jaccard._CELLS)], np.uint8)
    for percent in (85, 80, 60):
        levels = jaccard.Levels(percent)
        for _ in range(400):
            x, y = similar_sets(draw, percent)
            flat, offsets = np.array([*x, *y], np.uint64), np.array([0, len(x), len(x) + len(y)])
            text, token, place = jaccard.prefixes(flat, offsets, percent, weights)
            first = sorted(set(token[text == 0].tolist()) & set(token[text == 1].tolist()), key=lambda t: place[(text == 0) & (token == np.uint64(t))][0])
            assert first
            at = [place[(text == k) & (token == np.uint64(first[0]))][0] for k in (0, 1)]
            assert min(len(x) - at[0], len(y) - at[1]) >= -(-percent * (len(x) + len(y)) // (100 + percent))
            near = [jaccard.histograms(flat, offsets, levels, s) for s in (0, 1)]
            rows = pa.RecordBatch.from_arrays([pa.array([v]) for v in (1, len(x), near[0][0], near[1][0], 2, len(y), near[0][1], near[1][1])], names=list("abcdefgh"))
            assert [r.num_rows for r in jaccard._close_pairs(percent)([rows])] == [1]


def count_nothing(monkeypatch):
    """No cell counts as frequent, as it is with a passage of some hundred documents in a large table."""
    own = jaccard._meta

    def blind(size, percent):
        run = own(size, percent)
        return lambda batches: (b for b in run(batches) if not b.num_rows or b.column(0)[0].as_py() == 0)

    monkeypatch.setattr(jaccard, "_meta", blind)


def test_a_common_passage_makes_no_block(spark, monkeypatch):
    """Documents that share a passage and are not similar are no candidates, however many they are; near copies among them are."""
    passage = " ".join(words(40, 1))
    rows = [(i, f"{passage} {' '.join(f'w{i}x{k}' for k in range(100 + i % 3))}") for i in range(120)]
    rows += [(200 + i, f"{x} end") for i, x in rows[:3]]
    edges = []
    count_nothing(monkeypatch)
    monkeypatch.setattr(jaccard, "connected_components", lambda e, **more: (edges.append(e.count()), connected_components(e, **more))[1])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=4, percent=85, few=2).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 4, 85) and edges[0] == 3


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_members_of_a_token_s_group_link(most):
    """Groups in batches of any size: what is similar is in one part, by histograms or, in groups of more than most rows, by chains."""
    draw = random.Random(most)
    levels = jaccard.Levels(85)
    for _ in range(40):
        sets, rows = [], []
        for t in range(draw.randint(1, 4)):
            for _ in range(draw.choice([1, 2, 5, 9])):
                base = {draw.getrandbits(64) for _ in range(draw.choice([3, 20, 21, 90]))}
                for _ in range(draw.choice([1, 1, 3])):
                    own = {*base, *([draw.getrandbits(64)] if draw.random() < 0.5 else [])}
                    flat = np.array(sorted(own), np.uint64)
                    rows.append((t, len(sets), len(own), *(jaccard.histograms(flat, np.array([0, len(own)]), levels, s)[0] for s in (0, 1))))
                    sets.append(own)
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        cuts = sorted({0, len(rows), *[draw.randrange(len(rows) + 1) for _ in range(draw.randint(0, 6))]})
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:b]), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=list("abcde")) for a, b in zip(cuts, cuts[1:])]
        links = [r for b in jaccard._close_members(85, most)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        root = list(range(len(sets)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            root[top(i)] = top(j)
        of = {r[1]: r[0] for r in rows}
        assert all(of[i] == of[j] for i, j in links)
        assert all(top(i) == top(j) for i in of for j in of if of[i] == of[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))


def test_copies_meet_once():
    """Copies in batches of their own meet under the first token of each run of tokens that they have in common."""
    weights = type("Weights", (), {"value": np.zeros(jaccard._CELLS, np.uint8)})
    base = words(300, 5, 10**6)
    texts = [" ".join(base)] * 12 + [" ".join([*base, "more"])]
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    made = [r for i, x in enumerate(texts) for b in jaccard._tokens(4, 85, weights)(iter([pa.RecordBatch.from_pylist([{"id": i, "text": x}], schema)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    made.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=list("abcdef"))
    out = [r for k in range(0, len(made), 13) for b in jaccard._meeting(24, 85, True)(iter([batch.slice(k, 13)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {(r[2], r[4]) for r in out} == {(i, j) for j in range(13) for i in range(j)}
    assert len(out) <= 3 * 78 < len({r[0] for r in made}) * 78


def test_repeated_tokens_have_their_bits():
    """Marks in rows and flushes of any size: every token of two rows has its bit, few others have."""
    weights = type("Weights", (), {"value": np.zeros(jaccard._CELLS, np.uint8)})
    base = [" ".join(words(60, 50 + k, 10**6)) for k in range(40)]
    texts = [*base, *[f"{x} more" for x in base[:9]], *[f"{base[0]} m{k}" for k in range(7)]]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(range(k, k + 4), pa.int64()), "text": pa.array(texts[k : k + 4])}) for k in range(0, len(texts), 4)]
    tokens = [t for b in batches for t in jaccard._prefix_rows(4, 85, weights)(b)[3].tolist()]
    want = {t for t in tokens if tokens.count(t) > 1}
    for most in (1, 30, 1 << 19):
        marks = jaccard.Marks(len(tokens))
        sent = sorted((r for b in jaccard._sent_marks(4, 85, weights, None, marks, most)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        rows = [pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([m], pa.binary())], names=["part", "marks"]) for p, m in sent]
        bits = np.zeros(1 << marks.part_bits + marks.cell_bits - 3, np.uint8)
        for b in jaccard._repeated(marks)(iter(rows)):
            part, own = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py(), np.uint8)
            bits[part * len(own) : (part + 1) * len(own)] = own
        has = marks.has(bits, np.array(tokens, np.uint64))
        assert want <= {t for t, h in zip(tokens, has) if h} and has.sum() < len([t for t in tokens if t in want]) + 20


def test_equal_sets_have_equal_sums_wherever_they_stand():
    x = np.array([5, 7, 9], np.uint64)
    sums = jaccard.set_sums(np.concatenate([x, x, x[:2], x]), np.array([0, 3, 3, 6, 8, 11]))
    assert all(s[0] == s[2] == s[4] != s[3] and s[1] == 0 for s in sums)


@pytest.mark.parametrize("twins", [1 << 19, 0])
def test_lone_documents_and_copies_send_no_tokens(spark, monkeypatch, tmp_path, twins):
    """Of documents that share no shingle, and of copies of one set, no token is dealt out; without room for the classes copies are, to the same result."""
    own, seen = jaccard._meeting, str(tmp_path / "rows")

    def counted(*args):
        def told(batches):
            for b in batches:
                with open(seen, "a") as out:
                    out.write(f"{b.num_rows}\n")
                yield b

        return lambda batches: own(*args)(told(batches))

    monkeypatch.setattr(jaccard, "_meeting", counted)
    monkeypatch.setattr(jaccard, "_TWINS", twins)
    lone = [(i, " ".join(f"u{i}x{k}" for k in range(100))) for i in range(60)]
    rows = lone + [(100 + i, lone[0][1]) for i in range(30)] + [(200, f"{lone[1][1]} end")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shingle=4, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 4, 85)
    sent = sum(map(int, open(seen).read().split()))
    assert (2 <= sent <= 60) == bool(twins), sent


@pytest.mark.parametrize("few", [2, 24])
def test_what_shares_a_token_meets(few):
    """Streams of token rows in batches of any size: all rows of a group that may link come together, pairs or chains."""
    draw = random.Random(few)
    for _ in range(150):
        groups = [(t, s, draw.choice([1, 2, 3, 30])) for t in range(draw.randint(1, 6)) for s in (draw.choice([[0], [1, 2, 3]]))]
        rows, n_ids = [], 0
        for t, s, k in groups:
            for _ in range(k):
                rows.append((t, s, n_ids, draw.choice([10, 11, 13, 40, 41, 100]), 0))
                n_ids += 1
        rows.sort(key=lambda r: (r[0], r[1], r[3], r[2]))
        cuts = sorted({0, len(rows), *[draw.randrange(len(rows) + 1) for _ in range(draw.randint(0, 6))]})
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:b]), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=list("abcde")) for a, b in zip(cuts, cuts[1:])]
        out = [r for b in jaccard._meeting(few, 80)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        parts = sorted((t, a, i, b) for k, t, i, a, _, b in out if k == 2)
        links = [(i, j) for k, _, i, _, j, _ in out if k < 2]
        if parts:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(t, i, a, b) for t, a, i, b in parts]), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=list("abcd"))
            links += [r for b in jaccard._over_salts(80)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
        root = list(range(n_ids))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            root[top(i)] = top(j)
        for t, _, i, n, _ in rows:
            for u, _, j, m, _ in rows:
                if t == u and i < j and 100 * min(n, m) >= 80 * max(n, m) and min(n, m) >= -(-80 * (n + m) // 180):
                    assert top(i) == top(j)


def plain_repeats(rows, size):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest())):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = True
            seen.add(b[p : p + size])
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(b), [tuple(x) for x in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())], b[:0].join(b[k : k + 1] for k in np.flatnonzero(~gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,gram,stretch", [(100, 40, 4 << 20), (20, 8, 64), (9, 8, 4 << 20), (31, 11, 500)])
def test_repeats_go(spark, size, gram, stretch):
    draw = random.Random(size)
    pieces = ["".join(draw.choice("abcé ") for _ in range(draw.choice([5, 30, 99, 100, 101, 140, 300]))) for _ in range(25)]
    rows = [(i * 7 % 101, "".join(draw.choice(pieces) if draw.random() < 0.6 else "".join(draw.choice("xyz ") for _ in range(draw.randint(1, 150))) for _ in range(draw.randint(0, 5)))) for i in range(80)]
    rows += [(600 + k, draw.choice("pqr") * k + pieces[3][:60] + "zz" + thue_morse(700)[k % 2] + pieces[4]) for k in range(20)]  # one passage in different surroundings
    rows += [(500, "a" * 350), (501, "ab" * 200), (502, "a" * 99), (503, None), (504, ""), (505, rows[3][1]), (5, rows[9][1] + "q"), (5, rows[9][1]), (None, pieces[-1] * 2)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").repartition(4)
    got = substrings.remove_repeats(docs, size=size, gram=gram, stretch=stretch).collect()
    assert sorted([(r.id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in got], key=str) == plain_repeats(rows, size)


def test_places_pair_up_over_blocks_and_ranks_over_ranges(spark):
    """A text longer than a block of places, and many rows of one pair over several ranges of the sorted order."""
    draw = random.Random(8)
    long = "".join(draw.choice("abcdefgh ") for _ in range(1_100_000))
    rows = [(1, long), (2, long[500_000:500_300] + "!" + long[1_048_400:1_048_700] + "?"), *[(10 + k, f"{k:04d}" + "same words in every text of these " * 4 + f"{k:05d}") for k in range(300)]]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted([(r.id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in got], key=str) == plain_repeats(rows, 100)


def test_repeats_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).count() == 0


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(i, t, lang, f"src{i % 13}") for i, t, lang in language_rows()[:160]]
    boiler = "all rights of this page are reserved"
    rows = [(i, t + ("\n" + boiler if i % 2 and len(t) > 120 else ""), lang, s) for i, t, lang, s in rows]
    rows += [(1000 + k, rows[k][1] if len(rows[k][1]) > 150 else "the " * 3, rows[k][2], rows[k][3]) for k in range(40)] + [(2000, None, "xx", "src1"), (2001, "12 34", None, None), (2002, "", "yy", "src2")]
    item = " ".join(rows[4][1].split()[:12]) if len(rows[4][1].split()) > 12 else "the and the ing the and the ing the and tion"
    rows.append((3000, "tion " + item + " whing", "xx", "src3"))
    (tmp_path / "sf").mkdir()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    d = str(tmp_path / "sf")
    read = spark.read.parquet(f"{d}/documents.parquet")
    kept, columns = read, read.columns
    steps = {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.collect(), read.schema)
        steps[name] = {r.doc_id: r.text for r in kept.collect()}
    from tests.llm.test_small_ops import plain_lines

    assert not {2000, 2001, 2002} & set(steps["language"]) and len(steps["language"]) >= 0.97 * (len(rows) - 3)
    before = [r for r in rows if r[0] in steps["language"]]
    lines = {i: t for i, t, _ in plain_lines([(i, t, s) for i, t, _, s in before], 10, 10)}
    assert steps["lines"] == lines and any(boiler not in t for i, t in lines.items() if boiler in dict((r[0], r[1]) for r in rows)[i])
    groups = plain_components(list(lines.items()), 5, 80)
    assert set(steps["near_duplicates"]) == {i for i, n, c in groups if not n or i == c}
    bad = {i for i, _, hit, _ in plain_contamination(list(steps["near_duplicates"].items()), [(1, item)], 10) if hit}
    assert bad and set(steps["decontaminated"]) == set(steps["near_duplicates"]) - bad
    out = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == set(steps["decontaminated"])


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    import corpus_pipeline as pipeline

    a, b, c, d = (" ".join(words(30, 7000 + k)) for k in range(4))
    rows = [(5, a), (5, a), (None, a), (None, b), (None, b), (9, b), (5, c), (4, c), (None, d), (None, d), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(5, a), (9, b), (4, c), (None, d), (8, ""), (8, ""), (None, None)]))


def test_near_duplicates_with_a_common_passage_send_no_more_than_copies(spark, monkeypatch):
    """In the pipeline's stage too, more documents than `few` that share a passage are no candidates."""
    import corpus_pipeline

    passage = " ".join(words(40, 2))
    rows = [(i, f"{passage} {' '.join(f'v{i}x{k}' for k in range(100 + i % 3))}") for i in range(80)]
    rows += [(200 + i, f"{x} end") for i, x in rows[:3]]
    edges = []
    count_nothing(monkeypatch)
    monkeypatch.setattr(jaccard, "connected_components", lambda e, **more: (edges.append(e.count()), connected_components(e, **more))[1])
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(80)) and 3 <= edges[0] < 10  # histograms are a bound: a few more may pass


def test_histograms_tell_sets_of_two_thirds_in_common():
    """Pairs well below the bound don't pass: they would make blocks of documents that share a passage."""
    draw = random.Random(9)
    levels, passed = jaccard.Levels(80), 0
    for _ in range(100):
        both = [draw.getrandbits(64) for _ in range(240)]
        flat = np.array([*both, *(draw.getrandbits(64) for _ in range(60))] + [*both, *(draw.getrandbits(64) for _ in range(60))], np.uint64)
        near = [jaccard.histograms(flat, np.array([0, 300, 600]), levels, s) for s in (0, 1)]
        rows = pa.RecordBatch.from_arrays([pa.array([v]) for v in (1, 300, near[0][0], near[1][0], 2, 300, near[0][1], near[1][1])], names=list("abcdefgh"))
        passed += sum(b.num_rows for b in jaccard._close_pairs(80)([rows]))
    assert passed <= 2


@pytest.mark.parametrize("part", [16, 1 << 12])
def test_chains_of_a_token_send_no_texts_part_by_part(spark, monkeypatch, part):
    """A block that only a chain holds together is cut by histograms before any text is sent; similar sets stay together."""
    passage = " ".join(words(40, 3))
    rows = [(i, f"{passage} {' '.join(f'u{i}x{k}' for k in range(100 + i % 3))}") for i in range(120)]
    rows += [(200 + i, f"{x} end") for i, x in rows[:9]]
    sent = []
    own = jaccard.Scratch.table

    def table(self, name, df):
        out = own(self, name, df)
        if name.startswith("sent"):
            sent.append(out.count())
        return out

    count_nothing(monkeypatch)
    monkeypatch.setattr(jaccard.Scratch, "table", table)
    monkeypatch.setattr(jaccard, "_PART", part, raising=False)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=4, percent=85, few=2, most=5, block_shingles=1000).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 4, 85)
    assert sum(sent) <= len(rows)


def test_near_duplicates_move_no_text_to_leave_copies_out(spark):
    """However many ids go, up to a bound far above this table's, the rows that stay are not shuffled."""
    import corpus_pipeline

    rows = [(i, f"{' '.join(words(30, 8000 + i // 2))}") for i in range(60)]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in got.collect()) == list(range(0, 60, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
