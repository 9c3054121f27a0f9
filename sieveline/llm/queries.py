"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, licenses, pii, quality, sharding, spelling, topk, toxicity, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), percent=80)
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.coalesce("best", F.lit("")).alias("best"), "dice")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended in three arrivals of small shards, compacted on the way, and read through the manifest: what comes back for each document."""
    table = sharding.ShardTable(spark)
    docs = _table(spark, sf_dir, "documents")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for number in range(3):
        table.append(docs.where(arrival == number))
        if number:
            table.compact(target=32 << 20)
            table.vacuum()
    return table.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "source")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(_table(spark, sf_dir, "documents"), width=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return decontaminate.digest(report).drop("longest")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"), k=5, every=50, levels=256)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents"), least_values=3, confidence=0.5, rounds=3))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"), group=100, most=6)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, times=5)


def queries() -> dict:
    own = (
        op1_token_counts, op2_license_scan, op3_bpe, op4_warc, op5_quality, op6_sharding, op7_jaccard_join, op8_toxicity, op9_decontaminate, op10_exact_topk,
        op11_pii, op12_prefix_trie, op13_spelling,
    )
    return {f.__name__: f for f in own}


def _op2_sql() -> str:
    texts = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in licenses.templates_of())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH tw AS (SELECT row_number() OVER () AS t, name, regexp_extract_all({lower.format("body")}, '[a-z0-9]+') AS w FROM (VALUES {texts}) AS v(name, body)),
tb AS (SELECT t, name, len(w) AS length, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
tg AS (SELECT t, length, len(g) AS m, unnest(g) AS pair FROM tb),
u AS (
  SELECT doc_id, text AS unit FROM documents
  UNION SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents
  UNION SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM documents
), uw AS (SELECT doc_id, regexp_extract_all({lower.format("unit")}, '[a-z0-9]+') AS w FROM u WHERE unit IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all({lower.format("text")}, '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, w, i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM dw)),
hit AS (SELECT doc_id, t, length, m, i, count(*) OVER (PARTITION BY doc_id, t ORDER BY i RANGE BETWEEN CURRENT ROW AND length - 2 FOLLOWING) AS near FROM dp JOIN tg USING (pair)),
runs AS (SELECT DISTINCT doc_id, t, w[i : i + length - 1] AS w FROM hit JOIN dw USING (doc_id) WHERE near * 120 >= 80 * m),
ub AS (
  SELECT DISTINCT doc_id, NULL AS t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uw WHERE len(w) > 1
  UNION ALL SELECT DISTINCT doc_id, t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM runs
), m AS (
  SELECT doc_id, name, max(2.0::DOUBLE * len(list_intersect(ub.g, tb.g)) / (len(ub.g) + len(tb.g))) AS dice
  FROM ub JOIN tb ON (ub.t IS NULL OR ub.t = tb.t) AND 120 * len(ub.g) >= 80 * len(tb.g) AND 120 * len(tb.g) >= 80 * len(ub.g)
  WHERE 2 * len(list_intersect(ub.g, tb.g)) * 100 >= 80 * (len(ub.g) + len(tb.g)) GROUP BY doc_id, name
), r AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, first(name ORDER BY dice DESC, name) AS best, round(max(dice), 6) AS dice FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.licenses, '') AS licenses, coalesce(r.best, '') AS best, CAST(coalesce(r.dice, 0) AS DOUBLE) AS dice
FROM documents d LEFT JOIN r USING (doc_id)
"""


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

OP6_SQL = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, source FROM documents"

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b AS v, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT doc_id, i, win.m, item_id FROM pos JOIN lens ON i + lens.m - 1 <= len(w) JOIN win ON win.m = lens.m AND win.g = array_to_string(w[i : i + lens.m - 1], ' ')
), hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
    return byte


def _crc(text: str) -> str:
    nibble = "(instr('123456789ABCDEF', substr(hex(encode({0})), 2 * x + {1}, 1)))".format
    byte = f"({nibble(text, 1)} * 16 + {nibble(text, 2)})"
    return f"xor(list_reduce(list_transform(range(strlen({text})), lambda x: {byte}), lambda c, x: xor(c >> 8, {[_crc_entry(b) for b in range(256)]}[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


OP12_SQL = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT conv_id, list(d || ' ' || length(text) ORDER BY turn NULLS FIRST, role, d) AS w FROM o GROUP BY conv_id),
h AS (SELECT conv_id, w, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 6 AS INTEGER) AS h FROM s),
r AS (SELECT a.conv_id, list_concat(coalesce(b.w, [])[1 : a.h], a.w[a.h + 1 : len(a.w)]) AS w FROM h a LEFT JOIN s b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM r),
n AS (
  SELECT array_to_string(w[1 : d], ',') AS node, d AS depth, array_to_string(w[1 : greatest(d - 1, 0)], ',') AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE CAST(split_part(w[d], ' ', 2) AS BIGINT) END) AS chars,
    sha256(coalesce(string_agg(CASE WHEN len(w) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY 1, 2, 3
), c AS (SELECT p.node, p.depth, count(x.node) AS n_children FROM n p LEFT JOIN n x ON x.above = p.node AND x.depth = p.depth + 1 GROUP BY 1, 2),
t AS (
  SELECT a.node, a.depth, sum((b.n_convs - 1) * b.chars) AS saved, count(*) FILTER (k.n_children = 0) AS leaves
  FROM n a JOIN n b ON b.depth >= a.depth AND (a.depth = 0 OR b.node = a.node OR starts_with(b.node, a.node || ',')) JOIN c k ON k.node = b.node AND k.depth = b.depth GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN c USING (node, depth) JOIN t USING (node, depth) LEFT JOIN n p ON n.depth > 0 AND p.node = n.above AND p.depth = n.depth - 1
"""

OP13_SQL = rf"""
WITH RECURSIVE u AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS k FROM u WHERE length(w) >= 6 GROUP BY 1, 2),
hs AS (SELECT w, k, {_crc("s")} AS h FROM g),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, k FROM hs),
c AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
e AS (
  SELECT a.word AS a, b.word AS b, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN c b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN c b ON a.rest = b.word
), q AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -n, 'w': encode(b)}}) AS best, max(n) AS most FROM e GROUP BY a),
x AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN best END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM c LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM x UNION ALL SELECT r.word, x.form, step + 1 FROM r JOIN x ON x.word = r.root WHERE x.form IS NOT NULL)
SELECT x.word, x.form, z.root, x.n, CAST(x.n_near AS BIGINT) AS n_near, x.form_n FROM x JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) z ON z.word = x.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op4_warc": OP4_SQL, "op6_sharding": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_decontaminate": OP9_SQL, "op10_exact_topk": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling": OP13_SQL}
