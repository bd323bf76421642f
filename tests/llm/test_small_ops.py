"""WARC bundles, URL aliases, reply trees, line spread, top-k: edge cases and plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandlog.llm import chat, lines, queries, shared, topk, urls, warc
from strandlog.llm.components import connected_components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("at_driver", [0, 10**6])
def test_components_at_the_driver_and_in_rounds(spark, monkeypatch, at_driver):
    draw = random.Random(3)
    edges = [(draw.randrange(-300, 300), draw.randrange(-300, 300)) for _ in range(250)] + [(k, k - 1) for k in range(1000, 1400)] + [(2**62, 1399), (5, None)]
    tables = []
    monkeypatch.setattr(shared.Scratch, "table", lambda self, name, df, own=shared.Scratch.table: (tables.append(name), own(self, name, df))[1])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), at_driver=at_driver).collect()}
    want = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in edges:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want and (len(tables) == 2) == (at_driver > 0)


def test_warc_round_trip(spark, tmp_path):
    big, huge = "é" * 600, "x" * 700_000
    rows = [(1, "http://a/", big, 0), (2, "http://b/\r\nX: 1", big, 0), (5, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (6, "u", None, 0), (7, "u", "", 0), (8, "u", huge, 0), (None, "u", big, 0), (5, "again", big, 0), (9, "u", "\0\r\n\r\nWARC/1.1\r\n", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    bundles = warc.write_archive(pages, frame_bytes=4000, bundle_bytes=1500)
    back = warc.read_archive(bundles).collect()
    by = {}
    for r in back:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
        data = [b.bundle for b in bundles.collect() if r.frame < len(warc.frames(bytes(b.bundle)))]
        assert any(f"<{r.record_id}>".encode() in warc.read_record(bytes(x), r.frame, r.offset, r.length) for x in data)
    assert by[1] == [("revisit", 5, 1200)] and by[2] == [("revisit", 5, 1200)] and by[5] == [("response", None, 1200)] * 2 and by[None] == [("revisit", 5, 1200)]
    assert by[3] == by[4] == [("response", None, 5)] and by[6] == by[7] == [("response", None, 0)] and by[8] == [("response", None, 700_000)]
    assert {r.payload_digest for r in back if r.page_id == 1} == {hashlib.sha1(big.encode()).hexdigest()}
    index = warc.archive_index(bundles)
    assert "bundle:" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].replace("bundle_id", "")
    assert sorted((r.record_id, r.frame, r.offset, r.length) for r in index.collect()) == sorted((r.record_id, r.frame, r.offset, r.length) for r in back)
    wanted = spark.createDataFrame([("urn:page:8",), ("urn:page:1",), ("urn:page:1",), ("urn:page:77",), (None,), ("urn:page:5",)], "record_id string")
    got = sorted((r.record_id, bytes(r.record)) for r in warc.fetch_records(bundles, wanted).collect())
    assert [g[0] for g in got] == ["urn:page:1", "urn:page:5", "urn:page:5", "urn:page:8"] and huge.encode() in got[3][1] and all(f"<{i}>".encode() in x for i, x in got)
    (tmp_path / "out").mkdir()
    files = warc.export_archive(bundles, str(tmp_path / "out")).collect()
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "out" / f.file, "rb"), read_across_frames=True).read() for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type") == len(rows) and b"\r\nX: 1" not in text
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def test_a_broken_bundle_is_refused():
    with pytest.raises(ValueError):
        warc.frames(b"x" * 20)


RULES = [("block", "bad.com", "/"), ("allow", "bad.com", "/ok"), ("block", "net", "/de/")]


def by_sql(pages, rules):
    con = duckdb.connect()
    con.register("given", pages.toArrow())
    con.execute("CREATE TABLE pages AS SELECT page_id, url, html FROM given")
    return sorted(con.execute(queries.sql_of_op6(rules)).fetchall(), key=str)


def by_spark(pages, rules):
    return sorted((tuple(r) for r in urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_urls_take_verdicts_from_aliases(spark):
    link = '<link href="{}" rel=canonical>'.format
    rows = [
        (1, "http://a.org/1", link("http://BAD.com/x#f")), (2, "http://b.org/2", '<meta content="0; URL=http://a.org/1" http-equiv="Refresh">'), (3, "http://bad.com/ok/1", None), (4, "http://c.org/4", link("http://bad.com/ok/1")),
        (5, "http://d.org/5", ""), (6, None, link("http://bad.com/")), (7, "no host", "x"), (8, "http://x.NET/de/8?q", None), (9, "http://e.org/p/9", link("../r")), (10, "http://e.org/p/../r", link("/s")), (11, "http://e.org/s", link("//bad.com/z")), (5, "http://d.org/5", ""),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, verdict int")
    got = sorted((r.page_id, r.verdict, r.rule or "") for r in urls.judge_urls(pages, RULES).collect())
    assert got == sorted([(1, "block", ""), (2, "block", ""), (3, "allow", "bad.com/ok"), (4, "allow", ""), (5, "allow", ""), (5, "allow", ""), (6, "allow", ""), (7, "allow", ""), (8, "block", "net/de/"), (9, "block", ""), (10, "block", ""), (11, "block", "")])
    assert by_spark(pages, RULES) == by_sql(pages, RULES)
    more = spark.createDataFrame([("http://d.org/5", "http://bad.com/q")], "src string, dst string")
    assert {r.verdict for r in urls.judge_urls(pages, RULES, redirects=more).where("page_id = 5").collect()} == {"block"}
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert [r.verdict for r in urls.judge_urls(pages, spark.createDataFrame(RULES, "verdict string, host string, path string")).where("page_id = 2").collect()] == ["block"]
    hosts = pages.select(urls.url_host(F.col("url")).alias("h"), urls.url_path(F.col("url")).alias("p")).where("url like '%NET%'").first()
    assert tuple(hosts) == ("x.net", "/de/8")


def test_addresses_meet_however_they_are_written(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://x.org/p?a=1&b=2", ""), (2, "http://a.org/2", link("http://X.org:80/p?a=1&amp;b=2")), (3, "HTTPS://Bad.com:443/q/./r/../s", ""), (4, "http://a.org/4", link("https://bad.com/q/s")), (5, "http://a.org/5", link("http://a.org/4#top")),
        (6, "http://b.org", ""), (7, "http://a.org/x/y/7", link("../../../../z/.")), (8, "http://a.org/z/", link("?q=&#x31;&#49;")), (9, "http://bad.com/w", link("http://b.org/")), (None, "http://a.org/z/?q=11", link("http://bad.com/v")), (10, "http://c.org/&amp;lt;", None), (11, "http://c.org/1", link("/&amp;amp;lt;")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert by_spark(pages, [("block", "bad.com", "/")]) == by_sql(pages, [("block", "bad.com", "/")])
    got = {r.page_id: (r.verdict, r.component) for r in urls.judge_urls(pages, [("block", "bad.com", "/")]).collect()}
    assert {i: v for i, (v, _) in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "block", None: "block", 10: "allow", 11: "allow"}
    assert got[1][1] == got[2][1] and got[3][1] == got[4][1] == got[5][1] and got[6][1] == got[9][1] and got[7][1] == got[8][1] == got[None][1] and got[10][1] == got[11][1]


def test_many_rules_are_a_table(spark):
    rules = [("block", f"h{i}.example", "/") for i in range(3000)] + [("allow", "h7.example", "/ok"), ("block", "h7.example", "/ok"), ("block", "h9.example", "/x"), ("block", "h9.example", "/x")]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example/" + ("ok" if i % 2 else "x"), None) for i in range(3010)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: ("allow", "h7.example/ok") if i == 7 else ("allow", None) if i >= 3000 else ("block", f"h{i}.example/") for i in range(3010)}


def plain_branches(rows):
    """Branches of rows (tree, node, parent, role, text, score) by walking up from each leaf: {(tree, leaf): (nodes from the root, mean score)}."""
    trees = {}
    for tree, node, parent, role, text, score in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2], r[5] or 0.0, r[3] or "", r[4] or ""))):
        if tree is not None and node is not None:
            trees.setdefault(tree, {}).setdefault(node, (parent, score or 0.0, role or "", text or ""))
    out = {}
    for tree, own in trees.items():
        for leaf in set(own) - {p for p, *_ in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at not in path:
                out[tree, leaf] = path[::-1], sum(own[n][1] for n in path) / len(path), [own[n] for n in path[::-1]]
    return out


def test_reply_trees_rank_and_format(spark):
    rows = [(1, "r", None, "user", "q", 1.0), (1, "a", "r", "assistant", "good", 5.0), (1, "b", "r", "assistant", "bad", 0.0), (1, "c", "a", "user", "thanks", 5.0), (1, "d", "a", "user", "hm", None), (2, "x", "gone", "user", None, 0.0), (3, "p", "q", "user", "cycle", 9.0), (3, "q", "p", "assistant", "cycle", 9.0), (3, "s", "q", "user", "under a cycle", 9.0), (None, "n", None, "user", "no tree", 0.0), (4, None, None, "user", "no node", 1.0)]
    rows += [(5, "r", None, "user", "q", 1.0), (5, "r", None, "user", "q", 1.0), (5, "r", "k", "user", "other", 2.0), (5, "k", "r", "assistant", "one", 1.0), (5, "k", "r", "assistant", "two", 1.0), (5, "m", "r", "assistant", "tie", 1.0), (6, "z", "z", "user", "its own parent", 1.0)]
    nodes = spark.createDataFrame([(*r, 0, 0) for r in rows], "tree long, node string, parent string, role string, text string, score double, leaf int, rank int")
    trees = chat.ReplyTrees(nodes, score_col="score")
    want = plain_branches(rows)
    assert {(r.tree, r.leaf): (r.depth, r.score) for r in trees.branches().collect()} == {k: (len(p), s) for k, (p, s, _) in want.items()}
    best = trees.best(2)
    assert sorted((r.tree, r.leaf, r.rank) for r in best.collect()) == [(1, "c", 1), (1, "d", 2), (2, "x", 1), (5, "k", 1), (5, "m", 2)]
    paths = {}
    for r in trees.steps(best).collect():
        paths.setdefault((r.tree, r.leaf), {})[r.distance] = r.node
    assert {k: [v[i] for i in sorted(v, reverse=True)] for k, v in paths.items()} == {k: p for k, (p, _, _) in want.items() if k != (1, "b")}
    one = trees.formatted(trees.best()).where("tree = 1").first()
    assert one.formatted == "<s><|turn|>user\nq<|end|><|turn|>assistant\ngood<|end|><|turn|>user\nthanks<|end|></s>"
    assert [one.formatted[s.start : s.start + s.length] for s in one.loss_spans] == ["good"]
    none = chat.ReplyTrees(nodes.limit(0))
    assert none.branches().count() == 0 and none.formatted(none.best()).count() == 0


def test_branches_of_random_trees(spark):
    draw = random.Random(6)
    rows = [(t, n, draw.choice([None, n - 1, n - 1, draw.randrange(n + 1), draw.randrange(400)]) if n else None, "user", f"t{n}", draw.choice([None, 0.5, 1.0, 2.0])) for t in range(12) for n in range(draw.choice([1, 5, 60, 300]))]
    trees = chat.ReplyTrees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), score_col="score")
    want = plain_branches(rows)
    assert {(r.tree, r.leaf): (r.depth, round(r.score, 9)) for r in trees.branches().collect()} == {k: (len(p), round(s, 9)) for k, (p, s, _) in want.items()}


def test_a_long_trunk_with_many_leaves_stays_small(spark):
    """A trunk of n with n leaves has n * n steps; only the chosen branch's are written."""
    rows = [(1, i, i - 1 if i else None, 0.0) for i in range(300)] + [(1, 1000 + i, 299, float(i == 77)) for i in range(300)]
    trees = chat.ReplyTrees(spark.createDataFrame(rows, "tree long, node long, parent long, s double"), score_col="s", role_col=None, text_col=None)
    assert max(t.count() for t in trees.rounds) == 600 and len(trees.rounds) <= 10
    steps = trees.steps(trees.best())
    assert steps.count() == 301 and steps.agg(F.max("distance"), F.min("leaf"), F.max("leaf")).first()[:] == (300, 1077, 1077)


TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<|turn|>user\nx<|end|>", "<\\/s>", "", "é😀\n<s>", "[\\INST]", "<<SYS>>", "a\\", "<|end|>\\<|end|>", "x" * 50_000]


def test_control_strings_come_back(spark):
    conv = spark.createDataFrame([(i, t, role, x) for i in range(3) for t, (role, x) in enumerate([("user", TEXTS[(i + k) % len(TEXTS)]) if k % 2 else ("assistant", TEXTS[(i + k) % len(TEXTS)]) for k in range(12)])] + [(9, 1, "sys\n<|end|>", None), (9, 0, None, "t"), (9, 0, None, "t"), (None, 1, "user", "b"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    trees = chat.ReplyTrees(chat.conversation_nodes(conv), unique=True)
    out = trees.formatted(trees.best())
    rows = out.select(F.col("tree.id").alias("tree"), chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert sorted(r.tree is None for r in rows) == [False] * 4 + [True]
    want = {}
    for r in conv.collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    for r in rows:
        said = [(x[1], x[2]) for x in sorted(want[r.tree], key=lambda x: x[0])]
        assert [(t.role, t.text) for t in r.turns] == said
        assert r.loss == "".join(t for role, t in said if role == "assistant")


def plain_lines(rows, least, texts=1):
    bare = lambda text: "\n".join(x.strip(" ") for x in text.split("\n") if x.strip(" "))
    sites, kinds = {}, {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if x.strip(" ") and site is not None:
                sites.setdefault(x.strip(" "), set()).add(site)
                kinds.setdefault(x.strip(" "), set()).add(bare(text))
    spread = {x for x, s in sites.items() if len(s) >= least and len(kinds[x]) >= texts}
    out = []
    for i, text, _ in rows:
        parts = (text or "").split("\n")
        gone = sum(x.strip(" ") in spread for x in parts)
        out.append((i, "\n".join(x for x in parts if x.strip(" ") not in spread) if gone else text, gone))
    return sorted(out, key=str)


def test_spread_lines_go(spark):
    own = "this line is long and stands in one document only, number {}".format
    rows = [(i, f"{own(i)}\n  all rights reserved \n\nend {i % 3}", f"site{i % 7}") for i in range(60)]
    rows += [(100 + i, "all rights reserved\nend 1", f"site{i}") for i in range(4)] + [(None, own("x") + "\nall rights reserved", "site1"), (None, "end 2\n" + own("z"), "site1"), (200, None, "site2"), (201, "", "site2"), (202, own("y") + "\nall rights reserved", None), (3, own("other") + "\nall rights reserved", "site9"), (5, rows[5][1], "site5"), (6, "end 1\n\nend 1\n", "site1"), (7, "\n" * 3 + "end 2", "site1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept_text int")
    for least, texts in ((3, 1), (7, 1), (8, 1), (20, 1), (3, 5), (7, 21), (7, 22), (7, 23)):
        got = lines.remove_spread_lines(docs, least_sites=least, least_texts=texts)
        assert sorted([(r.doc_id, r.kept_text, r.removed_lines) for r in got.collect()], key=str) == plain_lines(rows, least, texts)
    assert lines.remove_spread_lines(docs.limit(0)).count() == 0


def test_short_pages_lose_their_boilerplate_and_whole_copies_may_stay(spark):
    licence = "\n".join(f"licence line {k} that every site repeats" for k in range(6))
    rows = [(i, f"{licence}\nown {i}", f"site{i}") for i in range(12)]  # more than half boilerplate
    rows += [(100 + i, "a story\nthat was copied" + "  \n" * (i % 2), f"site{i}") for i in range(12)]
    rows += [(200, licence, "site1"), (300, f"{licence}\ntwice", "site1"), (300, f"{licence}\ntwice", "site1"), (None, f"{licence}\nnull id", "site2"), (7, "a story\nown 7b", "site3"), (400, "the same first line\n" * 1, "site1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for texts in (1, 10):
        got = sorted([(r.doc_id, r.kept_text, r.removed_lines) for r in lines.remove_spread_lines(docs, least_texts=texts).collect()], key=str)
        assert got == plain_lines(rows, 10, texts)
        assert {g for g in got if g[0] is not None and g[0] < 12 and g[2] == 6} == {(i, f"own {i}", 6) for i in range(12)} and (200, "", 6) in got
        copies = {g[1] for g in got if g[0] is not None and 100 <= g[0] < 112}
        assert copies == ({""} if texts == 1 else {"a story\nthat was copied", "a story\nthat was copied  \n"})


def test_twenty_short_documents_with_one_line_in_common(spark):
    rows = [(i, f"a line of thirty letters or so it is\nx{i}", f"site{i}") for i in range(20)]
    got = lines.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.kept_text, r.removed_lines) for r in got.collect()} == {(i, f"x{i}", 1) for i in range(20)}


def test_a_long_text_of_spread_lines(spark):
    shared = [f"common line number {k}" for k in range(3000)]
    rows = [(i, "\n".join([*shared, f"own {i}", *shared]), f"site{i}") for i in range(11)]
    got = lines.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.kept_text, r.removed_lines) for r in got.collect()} == {(i, f"own {i}", 6000) for i in range(11)}


def test_many_sites_near_the_threshold(spark):
    rows = [(i, f"line {n}\n{'own text ' * 9}{i}-{n}", f"s{i}") for n in (95, 99, 100, 101, 120) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.remove_spread_lines(docs, least_sites=100).where("removed_lines > 0").select(F.substring_index("text", "\n", 1).alias("l")).distinct().collect()
    assert {r.l for r in got} == {"line 100", "line 101", "line 120"}


def plain_top(rows, k=5):
    """Every query row against every row of another id, in whole numbers without bound, cut to longs."""
    v = [(i, [math.floor(Fraction(x) * 256) if abs(x) > 1e300 else math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, mine in v:
        if q % 50 == 0:
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, e)))), i) for i, e in v if i != q and len(e) == len(mine))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def top(df, **options):
    return sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **options).drop("ask").collect()))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 4]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(500, None), (550, [float("nan")] * 8), (551, [None] + [0.1] * 7), (600, []), (601, []), (650, [0.5, 0.25]), (700, [float("inf")] * 8), (None, rows[3][1]), (17, rows[0][1]), (100, rows[7][1]), (100, rows[7][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    for block, pivots in ((2048, 12), (16, 3)):
        assert top(df, block=block, query_block=4, n_pivots=pivots) == plain_top(rows)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_every_finite_vector(spark):
    rng = np.random.default_rng(4)
    sizes = [0.25, 3.0, 4e5, 1e9, 3e15, 1e30, 1e160, 1.7e308]
    rows = [(i, [float(np.clip(x, -1, 1) * sizes[(i // 3) % len(sizes)]) for x in rng.normal(size=3)]) for i in range(240)]
    rows += [(1000, [1.7976931348623157e308, 0.0, 5e-324]), (1050, [4e5, -4e5, 0.0]), (1001, [-0.0, 1e30, -1e30])]
    for block in (2048, 8):
        assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block, query_block=4) == plain_top(rows)


def test_top_k_of_many_lengths_and_a_hot_one(spark):
    rng = np.random.default_rng(5)
    rows = [(50 * i + j, [float(x) for x in rng.integers(-3, 3, i)]) for i in range(1500) for j in (0, 1)]
    rows += [(10**6 + i, [0.5, -0.25, 1.0, 0.125]) for i in range(1500)]  # one vector over and over, its ids a tie
    got = top(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=64)
    want = plain_top([r for r in rows if r[0] < 10**6 or len(r[1]) == 4])
    assert got == want and len({q for q, *_ in got}) == 1500 + 30


def test_the_shared_folder_is_the_session_s(spark):
    assert shared.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
