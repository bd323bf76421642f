"""The queries of this subpackage and their SQL: one op<N>_<name> for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    bundles = write_archive(_read(spark, sf_dir, "pages"))
    return read_archive(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, F.coalesce(~held_out, F.lit(False)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op4_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import remove_spread_lines

    out = remove_spread_lines(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("removed_lines").alias("n_removed"), F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], given.schema)
    trees = chat.ReplyTrees(chat.conversation_nodes(given.unionByName(extra)), unique=True)
    out = trees.formatted(trees.best())
    out = out.select(F.col("tree.id").alias("conv_id"), "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h.stop - h.start)
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    out = jaccard_components(_read(spark, sf_dir, "documents"), shingle=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, payload_bytes, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes = w.payload_bytes
"""


def _op5_sql() -> str:
    from .chat import CLOSE, CONTROL, END, OPEN, TURN

    body = r"replace(text, '\', '\\')"
    for c in CONTROL:
        body = f"replace({body}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({body}) AS body_chars FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(TURN) + 1 + len(END)} + length(role) + body_chars) + {len(OPEN) + len(CLOSE)} AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""


_OP4_SQL = """
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d WHERE text IS NOT NULL),
s AS (SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
g AS (SELECT r, count(*) FILTER (t IS NOT NULL) AS n, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (t IS NULL), '') AS kept FROM l LEFT JOIN s ON t = trim(line) GROUP BY r),
j AS (SELECT d.doc_id, coalesce(g.n, 0) AS n, CASE WHEN g.n > 0 THEN g.kept ELSE d.text END AS kept FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM j
"""

_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
o AS (SELECT p.doc_id, p.k, i.m, i.item_id FROM p JOIN (SELECT DISTINCT m FROM i) s ON p.k + s.m - 1 <= len(p.w) JOIN i ON i.m = s.m AND i.g = array_to_string(p.w[p.k:p.k + s.m - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.x, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON r.x = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.x = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""

_OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _node_sql(url: str) -> str:
    """A url as a node, as urls.node has it."""
    scheme, place, path, query = (f"regexp_extract({url}, '^(.*?)://([^/?#]*)([^?#]*)([^#]*)', {k}, 's')" for k in (1, 2, 3, 4))
    scheme = f"translate({scheme}, {_AZ})"
    user, host = f"regexp_extract({place}, '^(.*@)?(.*)$', 1, 's')", f"translate(regexp_extract({place}, '^(.*@)?(.*)$', 2, 's'), {_AZ})"
    host = f"CASE WHEN ({scheme} = 'http' AND ends_with({host}, ':80')) OR ({scheme} = 'https' AND ends_with({host}, ':443')) OR ends_with({host}, ':') THEN regexp_replace({host}, ':[0-9]*$', '') ELSE {host} END"
    parts = f"string_split(substr({path}, 2), '/')"
    kept = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda x: [x])), lambda a, x: CASE x[1] WHEN '..' THEN a[:len(a) - 1] WHEN '.' THEN a ELSE a || x END)"
    ends = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END"
    resolved = f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN '/' || array_to_string({kept} || {ends}, '/') ELSE {path} END"
    return f"CASE WHEN contains({url}, '://') THEN {scheme} || '://' || {user} || {host} || {resolved} || {query} END"


def _decoded_sql(text: str) -> str:
    """Entities of an attribute as their characters, as urls.decoded has it."""
    from .urls import ENTITIES

    quoted = lambda c: "''" if c == "'" else c
    named = " ".join(f"WHEN starts_with(p, '{n}') THEN '{quoted(c)}' || substr(p, {len(n) + 1})" for n, c in ENTITIES.items())
    number = "WHEN regexp_matches(p, '^#[0-9]{1,6};') THEN chr(CAST(regexp_extract(p, '^#([0-9]{1,6});', 1) AS INTEGER)) || regexp_replace(p, '^#[0-9]{1,6};', '')"
    code = "list_reduce(list_prepend(0, list_transform(string_split(upper(regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,5});', 1)), ''), lambda d: strpos('0123456789ABCDEF', d) - 1)), lambda a, d: 16 * a + d)"
    number += f" WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{{1,5}};') THEN chr(CAST({code} AS INTEGER)) || regexp_replace(p, '^#[xX][0-9a-fA-F]{{1,5}};', '')"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p {number} {named} ELSE '&' || p END), '')"


_OP6_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, row_number() OVER () AS n, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_AZ}), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES {{rules}}),
tags AS (SELECT url, unnest([
  regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?canonical["''\\s>/]'))[1], '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
  regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b'))[1], '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?url\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS raw
  FROM u WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
t AS (SELECT url, {_decoded_sql("raw")} AS raw, regexp_extract(url, '^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1, 's') AS folder FROM tags WHERE raw <> ''),
e AS (SELECT {_node_sql("url")} AS a, {_node_sql("target")} AS b FROM (SELECT url, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN raw WHEN starts_with(raw, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || raw
  WHEN starts_with(raw, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || raw WHEN starts_with(raw, '?') THEN regexp_extract(url, '^(.*?://[^?#]*)', 1, 's') || raw
  WHEN ends_with(folder, '/') THEN folder || raw ELSE folder || '/' || raw END AS target FROM t)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS node, a AS reached FROM g UNION SELECT c.node, g.b FROM c JOIN g ON g.a = c.reached),
m AS (SELECT DISTINCT reached, translate(regexp_extract(reached, '^.*?://([^/?#]*)', 1, 's'), {_AZ}) AS host, regexp_extract(reached, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM c),
v AS (SELECT m.reached, r.verdict, row_number() OVER (PARTITION BY m.reached ORDER BY length(r.host || r.path) DESC, r.verdict) AS k FROM m JOIN r ON (m.host = r.host OR ends_with(m.host, '.' || r.host)) AND starts_with(m.path, r.path)),
l AS (SELECT c.node, CASE WHEN bool_or(v.verdict = 'allow') THEN 'allow' WHEN bool_or(v.verdict = 'block') THEN 'block' END AS verdict FROM c LEFT JOIN v ON v.reached = c.reached AND v.k = 1 GROUP BY c.node),
f AS (SELECT u.n, u.page_id, u.url, u.host, u.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC NULLS LAST, r.verdict) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(f.verdict, l.verdict, 'allow') AS verdict FROM f LEFT JOIN l ON l.node = ({_node_sql("f.url")}) WHERE k = 1
"""


def sql_of_op6(rules: list[tuple[str, str, str]]) -> str:
    return _OP6_SQL.replace("{rules}", ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules))


def oracle_sql() -> dict[str, str]:
    """SQL for the same rows."""
    return {"op1_warc_bundles": _OP1_SQL, "op4_site_spread_lines": _OP4_SQL, "op5_reply_trees": _op5_sql(), "op6_url_aliases": sql_of_op6(URL_RULES), "op8_prefix_windows": _OP8_SQL, "op9_prefix_tree_join": _OP9_SQL, "op10_pivot_top_k": _OP10_SQL}
