"""The registered queries over small whole tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import random
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlog.llm import queries
from tests.llm.test_text_ops import plain_components, plain_repeats, thue_morse, words

ALL = queries.queries()
CLASHES = {"documents": "component int, kept_text string, n_shingles long, spans int", "pages": "host string, verdict int, digest int", "embeddings": "rank int, slots int", "conversations": "leaf int, formatted string, node int", "benchmark": "item int, part int"}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>", "conversations": "conv_id long, turn long, role string, text string", "benchmark": "item_id long, text string",
}


def tables():
    draw = random.Random(21)
    long = " ".join(words(30_000, 5, 3000))  # some 150 kB
    shared = " ".join(words(40, 77, 4000))
    lang = {0: ("en", "the and ing tion of wh"), 1: ("de", "der ung sch über ß keit"), 2: ("fr", "que é les ç ment où")}
    texts = []
    for i in range(60):
        name, stock = lang[i % 3]
        own = " ".join(draw.choice(stock.split()) + str(draw.randrange(400)) for _ in range(draw.choice([1, 3, 30, 80])))
        texts.append((i, own + (f"\n{shared}" if i % 5 == 0 else "") + ("\nall rights reserved" if i % 2 else ""), name))
    texts += [(100 + i, t, name) for i, (_, t, name) in enumerate(texts[:20])] + [(130 + i, t.replace("7", "8", 1), name) for i, (_, t, name) in enumerate(texts[:20])]
    texts += [(200, None, "en"), (201, "", "de"), (202, " \n\t ", None), (203, "12 34 !?", "fr"), (204, long, "en"), (205, long[:-50] + " x", "en"), (206, "w" * 150_000, None), (207, "</s><|endoftext|> é", "fr"), (3, texts[3][1], "en"), (3, "other text", "en"), (208, thue_morse(1024)[0], None), (209, thue_morse(1024)[1], None)]
    docs = [(i, t, name, None if i == 11 else f"src{i % 13}", len(t or "")) for i, t, name in texts]
    pages = [(i, f"http://{h}.{z}/{p}/{i}?q#f", draw.choice(["x" * 1200, "y" * 999, "é" * 600, f"<p>{i}"])) for i in range(40) for h, z, p in [(draw.choice(["example", "www.example", "a"]), draw.choice(["com", "net", "org"]), draw.choice(["en", "de", "es"]))]]
    pages += [(100, None, None), (101, "nowhere", ""), (102, "http://b.info/", '<link rel="canonical" href="http://www.EXAMPLE.com:80/en/1">'), (103, "HTTP://Q.org/es/", "x" * 150_000), (3, pages[3][1], pages[3][2]), (None, "http://c.com/en/", "x" * 1200)]
    vectors = [(i, [draw.randrange(-8, 8) / 16 for _ in range(4)]) for i in range(150)] + [(200, None), (250, []), (251, []), (300, [0.5]), (350, [float("nan")] * 4), (151, [0.0] * 4), (152, [0.0] * 4)]
    talk = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["hi", "", None, "</s>[INST] ok [/INST]", "\\", "é" * 50])) for c in range(12) for t in range(draw.randint(1, 9))]
    talk += [(50, 0, "user", "long " * 60_000), (50, 1, "assistant", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    items = [(i, " ".join(words(draw.choice([4, 12, 25]), 300 + i, 3000))) for i in range(15)] + [(50, shared), (51, long[1000:1300]), (52, None), (53, "?"), (None, "the"), (50, shared), (54, "The"), (55, long)]
    return {"documents": docs, "pages": pages, "embeddings": vectors, "conversations": talk, "benchmark": items}


def write(spark, folder, rows):
    for name, own in rows.items():
        clash = CLASHES[name]
        df = spark.createDataFrame([(*r, *[None] * len(clash.split(","))) for r in own], f"{SCHEMAS[name]}, {clash}")
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), tables())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {name: [] for name in SCHEMAS})


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if not n.startswith("op9_")))
def test_query_equals_its_sql(spark, small, name):
    """The SQL of op1, op8 and op9 joins on ids; rows that repeat one, or have none, are tested by plain versions."""
    con = duckdb.connect()
    for t in SCHEMAS:
        where = " WHERE doc_id NOT IN (3, 204, 205)" if t == "documents" and name.startswith("op8_") else " WHERE page_id IS NOT NULL" if t == "pages" and name.startswith("op1_") else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet/*.parquet'{where}")
    want = con.execute(queries.oracle_sql()[name])
    got = ALL[name](spark, small)
    if name.startswith("op8_"):
        long = {r.doc_id: (r.n_hit, r.n_words) for r in got.where("doc_id IN (204, 205)").collect()}
        assert long[204] == (30_000, 30_000) and long[205][1] - 30 < long[205][0] < long[205][1]  # one of the items is the long text
        got = got.where("doc_id NOT IN (3, 204, 205)")
    if name.startswith("op1_"):
        got = got.where("page_id IS NOT NULL")
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_op2_places_every_id_once(spark, small):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text, *_ in tables()["documents"]:
        want.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    pieces, packs = {}, {}
    for r in ALL["op2_length_packing"](spark, small).collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted({(i, len(x)) for i, xs in want.items() for x in xs})
    for i, xs in want.items():
        for x in xs:
            own = sorted(p for p in pieces[i, len(x)])
            if len([y for y in xs if len(y) == len(x)]) == 1:
                assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == len(x)
            assert {(s, n, zlib.crc32(struct.pack(f"<{n}I", *x[s : s + n]))) for s, n, _ in own} & set(own)
    for p in packs.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(2048 - sum(n for _, n in p) for p in packs.values()) < 2048 + 0.05 * sum(len(x) for xs in want.values() for x in xs)


def test_op3_holds_its_contract(spark, small):
    given = tables()["documents"]
    got = ALL["op3_subword_language"](spark, small).collect()
    assert len(got) == len(given) and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"} and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    und = sorted(i for i, t, *_ in given if not any(c.isalpha() for c in t or ""))
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == und


def test_op7_equals_a_plain_version(spark, small):
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(bytes(kept)).hexdigest()) for i, n, spans, kept in plain_repeats([(i, t) for i, t, *_ in tables()["documents"]], 100)]
    assert sorted(map(tuple, ALL["op7_prefix_doubling"](spark, small).collect()), key=str) == sorted(want, key=str)


def test_op9_takes_rows_that_repeat_an_id_as_one_node(spark, small):
    given = [(i, t) for i, t, *_ in tables()["documents"] if i not in (204, 205, 206)]
    got = [tuple(r) for r in ALL["op9_prefix_tree_join"](spark, small).where("doc_id NOT IN (204, 205, 206)").collect()]
    assert sorted(got, key=str) == plain_components(given, 4, 85)


@pytest.mark.parametrize("name", sorted(ALL))
def test_queries_over_empty_tables(spark, empty, name):
    got = ALL[name](spark, empty).collect()
    assert len(got) == (1 if name.startswith("op5_") else 0)


def test_the_pipeline_over_these_tables_and_over_empty_ones(spark, small, empty):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == spark.read.parquet(f"{small}/documents.parquet").columns, name
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert ids and not {200, 201, 202, 203} & set(ids)
    assert {r.doc_id for r in pipeline.run(spark, small).collect()} == set(ids)
    assert pipeline.run(spark, empty).collect() == []
