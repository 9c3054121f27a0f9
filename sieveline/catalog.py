"""The registered queries of the library's own operators, with their SQL.

The tables stand in for code: documents are objects (source is the package), pages files, conversations ordered fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import classify as C
from .functions import fixed
from .functions import text as T
from .operators import dataset, inference, objects, report, scoring, triage, windows
from .plans import sql as S
from .session import shared_folder, spread, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir) -> DataFrame:
    """The whole text of every document as an argument."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("arg")))


_TEXTS_SQL = "(SELECT doc_id, source, text AS arg FROM documents)"

# ---- predicates ----
_TESTS = {
    "ip": T.is_ip, "version": T.is_version, "encoding": T.is_encoding, "url": T.is_url, "contains_url": T.contains_url, "localhost": T.is_localhost, "file_path": T.is_file_path, "escaped_hex": T.is_escaped_hex,
    "base64": T.is_base64, "hex": T.is_hex, "bash": T.is_bash, "code": T.is_code, "sql": T.is_sql, "large_payload": T.is_large_payload,
}
for _name, _test in _TESTS.items():
    query(f"pred_{_name}", f"SELECT doc_id, {S.PREDICATES[_name]('arg')} AS hit FROM {_TEXTS_SQL}")(lambda spark, sf, t=_test: texts(spark, sf).select("doc_id", t("arg").alias("hit")))
for _name in ("url", "contains_url", "file_path"):
    query(f"pred_{_name}_pages", f"SELECT page_id, {S.PREDICATES[_name]('url')} AS hit FROM pages")(lambda spark, sf, t=_TESTS[_name]: table(spark, sf, "pages").select("page_id", t("url").alias("hit")))
for _name in ("bash", "code", "sql"):
    query(f"pred_{_name}_pages", f"SELECT page_id, {S.PREDICATES[_name]('html')} AS hit FROM pages")(lambda spark, sf, t=_TESTS[_name]: table(spark, sf, "pages").select("page_id", t("html").alias("hit")))

query("size_bucket", f"SELECT doc_id, {S.size_bucket('arg')} AS bucket FROM {_TEXTS_SQL}")(lambda spark, sf: texts(spark, sf).select("doc_id", T.size_bucket("arg").alias("bucket")))
query("strip_quotes", f"SELECT doc_id, {S.strip_quotes('arg')} AS v FROM {_TEXTS_SQL}")(lambda spark, sf: texts(spark, sf).select("doc_id", T.strip_quotes("arg").alias("v")))
query("normalise_text", f"SELECT doc_id, v FROM ({S.normalised_from(_TEXTS_SQL, 'arg', 'doc_id')})")(lambda spark, sf: texts(spark, sf).select("doc_id", T.normalised("arg").alias("v")))


# ---- cascade ----
@query("classify_string", f"SELECT token, count(*) AS n FROM (SELECT {S.classify('v')} AS token FROM ({S.normalised_from(_TEXTS_SQL, 'arg', 'doc_id')}) WHERE v IS NOT NULL) GROUP BY token")
def classify_string(spark, sf):
    """Classes of the whole texts with their counts."""
    return texts(spark, sf).where("arg IS NOT NULL").select(C.classified("arg").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_OP = "(ARRAY" + str(S.OPCODES) + ")[1 + CAST((doc_id // 50) % 11 AS INT)]"


def _pairs(tables: dict) -> str:
    return ", ".join(f"({S.q(k)}, {S.q(v)})" for k, v in tables.items())


_MAP_SQL = f"""
WITH f(name, category) AS (VALUES {_pairs(fixed.FUNCTION_MAP["python"])}), i(name, category) AS (VALUES {_pairs(fixed.IMPORT_MAP["python"])}),
x AS (SELECT doc_id, arg, {_OP} AS op FROM {_TEXTS_SQL}),
n AS ({S.normalised_from("x", "arg", "doc_id, arg, op")})
SELECT doc_id, CASE WHEN arg IS NULL OR arg = '' THEN op
  WHEN op IN ('POP_JUMP_IF_FALSE', 'POP_JUMP_IF_TRUE', 'JUMP_FORWARD', 'MAKE_CLASS', 'MAKE_FUNCTION') THEN op
  WHEN op IN ('IMPORT_FROM', 'IMPORT_NAME') AND i.category IS NOT NULL THEN op || ' ' || i.category
  WHEN op IN ('STORE_NAME', 'LOAD_NAME', 'STORE_GLOBAL', 'LOAD_GLOBAL') AND f.category IS NOT NULL THEN op || ' ' || f.category
  WHEN op = 'CALL' THEN op || ' ' || v WHEN op IN ('POP_TOP', 'PUSH_NULL') THEN op WHEN op IN ('COPY', 'KW_NAMES') THEN op || ' ' || v
  ELSE op || ' ' || {S.classify("v")} END AS token
FROM n LEFT JOIN f ON f.name = v LEFT JOIN i ON i.name = v
"""


@query("map_argument", _MAP_SQL)
def map_argument(spark, sf):
    """The full cascade on instructions with whole texts."""
    op = F.element_at(F.array(*map(F.lit, S.OPCODES)), (F.floor(F.col("doc_id") / 50) % 11 + 1).cast("int"))
    return texts(spark, sf).select("doc_id", C.map_argument(op, F.lit("str"), F.col("arg"), F.lit("python")).alias("token"))


@query(
    "map_argument_typed",
    """SELECT l_orderkey, l_linenumber, CASE CAST((l_orderkey + l_linenumber) % 6 AS INT) WHEN 0 THEN 'LOAD_CONST BOOLEAN' WHEN 1 THEN 'LOAD_CONST INTEGER' WHEN 2 THEN 'LOAD_CONST FLOAT'
       WHEN 3 THEN 'LOAD_CONST' WHEN 4 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'LOAD_CONST ' || array_to_string(list_sort(['FLOAT', 'INTEGER', l_returnflag]), ' ') ELSE 'LOAD_CONST INTEGER' END ELSE 'JUMP_BACKWARD ' || CAST(l_linenumber AS STRING) END AS token FROM lineitem""",
)
def map_argument_typed(spark, sf):
    """Types decide before texts: true, ints, floats, zeros, tuples, jumps."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    n = F.col("l_linenumber").cast("string")
    kind = F.when(k == 0, "bool").when(k == 1, "int").when(k == 2, "float").when(k == 3, "int").when(k == 4, "tuple").otherwise("int")
    arg = F.when(k == 0, "True").when(k == 2, F.concat(n, F.lit(".5"))).when(k == 3, "0").when(k == 4, "(..)").otherwise(n)
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    items = F.when(F.col("l_linenumber") % 2 == 0, F.array(item("str", F.col("l_returnflag")), item("int", n), item("float", n), item("str", F.col("l_returnflag")))).otherwise(F.array(item("bool", n)))
    op = F.when(k == 5, "JUMP_BACKWARD").otherwise("LOAD_CONST")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.map_argument(op, kind, arg, F.lit("python"), items).alias("token"))


@query("tuple_token", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, 'INTEGER', p_brand])), ' ') AS token FROM part")
def tuple_token(spark, sf):
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("text"))
    return table(spark, sf, "part").select("p_partkey", C.tuple_token(F.array(item("str", "p_brand"), item("str", "p_type"), item("int", "p_size"), item("str", "p_brand"))).alias("token"))


# ---- files ----
_PATHS_SQL = "(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS package, 'f' || CAST(page_id AS STRING) || (['.py', '.JS', '.mjs', '.txt', '', '.cjs'])[1 + page_id % 6] AS path, length(html) AS size FROM pages)"


def paths(spark, sf) -> DataFrame:
    from .sources.files import with_extension

    suffix = F.element_at(F.array(*map(F.lit, [".py", ".JS", ".mjs", ".txt", "", ".cjs"])), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("package"), F.concat(F.lit("f"), F.col("page_id").cast("string"), suffix).alias("path"), F.length("html").cast("long").alias("size"))
    return with_extension(rows, "path")


_EXT = "lower(regexp_extract(path, '[.]([^./]*)$', 1))"


@query("lang_by_extension", f"SELECT page_id, CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' ELSE 'python' END AS language FROM {_PATHS_SQL}")
def lang_by_extension(spark, sf):
    from .sources.files import language

    return paths(spark, sf).select("page_id", language(F.col("extension")).alias("language"))


@query("file_types", f"SELECT package, coalesce(array_to_string(list_sort(list_distinct(list({_EXT}) FILTER (WHERE {_EXT} <> ''))), ','), '') AS types FROM {_PATHS_SQL} GROUP BY package")
def file_types(spark, sf):
    from .sources.files import file_types as types

    return types(paths(spark, sf), "package").select("package", F.array_join("types", ",").alias("types"))


@query("scan_accept_skip", f"SELECT {_EXT} IN ('py', 'js', 'mjs', 'cjs') AS accepted, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {_PATHS_SQL} GROUP BY 1")
def scan_accept_skip(spark, sf):
    from .sources.files import accepted

    return paths(spark, sf).groupBy(accepted(F.col("extension")).alias("accepted")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    "human_size",
    """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS package, CASE WHEN s < 1024 THEN printf('%.1f B', s) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576)
       WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824) ELSE printf('%.1f TB', s / 1099511627776) END AS size FROM (SELECT url, CAST(sum(strlen(html)) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS DOUBLE) AS s FROM pages) GROUP BY ALL""",
)
def human_size(spark, sf):
    rows = table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("package")).agg(F.sum(F.octet_length("html")).alias("s"))
    return rows.select("package", T.human_size("s").alias("size"))


@query("load_nonblank", r"SELECT regexp_replace(arg, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS arg FROM " + _TEXTS_SQL + r" WHERE arg IS NOT NULL AND regexp_replace(arg, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> ''")
def load_nonblank(spark, sf):
    return dataset.load_nonblank(texts(spark, sf), "arg")


# ---- objects: two instructions for each document ----
_OBJ_SQL = f"""(SELECT doc_id, source, path, size, v1, v2, CASE WHEN path IN ('setup.py', '__init__.py') THEN 'TARGETED_FILE ' ELSE '' END AS aim FROM (
  SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'setup.py' ELSE 'm.py' END AS path, n_chars * 100 AS size,
    'LOAD_NAME ' || CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'DYNAMIC_CODE_EXECUTION' WHEN 1 THEN 'NETWORK_HTTP_REQUEST' ELSE 'foo' END AS v1,
    'LOAD_CONST ' || CASE WHEN v IS NULL OR v = '' THEN '' ELSE {S.classify("v")} END AS v2
  FROM ({S.normalised_from("documents", "text", "doc_id, source, n_chars")})))"""


def code_objects(spark, sf) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"))
    name = F.when(F.col("doc_id") % 3 == 0, "eval").when(F.col("doc_id") % 3 == 1, "requests").otherwise("foo")
    ins = lambda op, arg: F.struct(F.lit(op).alias("opcode"), F.lit("str").alias("arg_kind"), arg.alias("arg"), F.lit("python").alias("language"), F.expr("cast(array() as array<struct<kind:string,text:string>>)").alias("items"))
    return d.select(
        "doc_id", "source", F.concat(F.lit("o"), (F.col("doc_id") % 5).cast("string")).alias("name"), F.lit("python").alias("language"),
        F.when(F.col("doc_id") % 7 == 0, "setup.py").otherwise("m.py").alias("file_path"), (F.col("n_chars") * 100).alias("file_size"),
        F.expr("cast(array() as array<string>)").alias("warnings"), F.array(ins("LOAD_NAME", name), ins("LOAD_CONST", F.col("text"))).alias("instructions"),
    )


_TOKENS_SQL = "CASE WHEN size > 512000 THEN 'LARGE_FILE ' ELSE '' END || CASE WHEN size > 1048576 THEN 'PATHOLOGICAL_FILE ' ELSE '' END || aim || v1 || ' ' || trim(v2)"


@query("object_tokens", f"SELECT doc_id, {_TOKENS_SQL} AS token_string FROM {_OBJ_SQL}")
def object_tokens(spark, sf):
    return objects.with_tokens(code_objects(spark, sf)).select("doc_id", "token_string")


@query("object_hash", f"SELECT doc_id, sha256(aim || v1 || ' ' || trim(v2)) AS hash FROM {_OBJ_SQL}")
def object_hash(spark, sf):
    return objects.with_tokens(code_objects(spark, sf)).select("doc_id", "hash")


@query("first_by_name", "SELECT source, name, doc_id FROM (SELECT source, 'o' || CAST(doc_id % 5 AS STRING) AS name, min(doc_id) AS doc_id FROM documents GROUP BY ALL)")
def first_by_name(spark, sf):
    return objects.first_by_name(code_objects(spark, sf), ["source"], "name", ["doc_id"]).select("source", "name", "doc_id")


_VOCABULARY = "[" + ", ".join(map(S.q, sorted({*fixed.STRING_TOKENS, *fixed.SIZE_TOKENS, *fixed.FILE_TOKENS, *fixed.TYPE_TOKENS, *fixed.FUNCTIONS, *fixed.PYTHON_IMPORTS}))) + "]"
_EACH_WORD = r"SELECT unnest(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> '')) AS token FROM documents"


@query("vocabulary_dim", f"SELECT token, coalesce(n, 0) AS n FROM (SELECT unnest({_VOCABULARY}) AS token) LEFT JOIN (SELECT token, count(*) AS n FROM ({_EACH_WORD}) GROUP BY token) USING (token)")
def vocabulary_dim(spark, sf):
    """All tokens of a language, and how often each stands in the texts as it is."""
    found = dataset.token_frequency(table(spark, sf, "documents"), "text", "doc_id").select("token", F.col("count").alias("n"))
    tokens = spark.createDataFrame([(t,) for t in objects.special_tokens("python")], "token string")
    return tokens.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_GATE_SQL = f"regexp_matches(t, '{'|'.join(sorted(fixed.FUNCTIONS))}')"


@query("gate_objects", f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS_SQL} AS t FROM {_OBJ_SQL}) WHERE {_GATE_SQL}")
def gate_objects(spark, sf):
    return objects.with_tokens(code_objects(spark, sf)).where(objects.gate(F.col("token_string"), F.col("language"))).select("doc_id")


# score: weights of distinct tokens; in these objects only the two mapped names and the string's class weigh
_SCORED_SQL = f"""(SELECT *, CASE WHEN {_GATE_SQL} THEN round(1 / (1 + exp(-({scoring.BIAS}
   {"".join(f" + CASE WHEN list_contains(string_split(v1, ' '), '{k}') OR v2 = 'LOAD_CONST {k}' THEN {w} ELSE 0 END" for k, w in scoring.WEIGHTS.items())}))), 6) END AS score
   FROM (SELECT *, {_TOKENS_SQL} AS t FROM {_OBJ_SQL}))"""


def scored(spark, sf) -> DataFrame:
    o = objects.with_tokens(code_objects(spark, sf))
    return o.withColumn("score", F.when(objects.gate(F.col("token_string"), F.col("language")), F.round(scoring.linear_score(F.col("tokens")), 6)))


@query("score_objects", f"SELECT doc_id, score FROM {_SCORED_SQL}")
def score_objects(spark, sf):
    return scored(spark, sf).select("doc_id", "score")


@query("flag_objects", f"SELECT doc_id, score FROM {_SCORED_SQL} WHERE score > 0.2")
def flag_objects(spark, sf):
    return scored(spark, sf).where(report.flagged(F.col("score"), 0.2)).select("doc_id", "score")


@query(
    "package_verdict",
    f"""SELECT source, count(*) AS objects, CAST(coalesce(sum(CAST(score > 0.2 AS INT)), 0) AS BIGINT) AS flagged, round(coalesce(avg(score) FILTER (WHERE score > 0.2), 1.0), 5) AS confidence,
        CASE WHEN coalesce(sum(CAST(score > 0.2 AS INT)), 0) > 0 THEN 'malicious' ELSE 'good' END AS verdict FROM {_SCORED_SQL} GROUP BY source""",
)
def package_verdict(spark, sf):
    return report.package_verdict(scored(spark, sf), "source", "score", 0.2).withColumn("confidence", F.round("confidence", 5))


@query(
    "package_stats",
    f"""SELECT package, count(*) AS total_files, CAST(sum(CAST({_EXT} NOT IN ('py', 'js', 'mjs', 'cjs') AS INT)) AS BIGINT) AS skipped_files, CAST(sum(CAST({_EXT} IN ('py', 'js', 'mjs', 'cjs') AS INT)) AS BIGINT) AS processed_files,
        coalesce(array_to_string(list_sort(list_distinct(list({_EXT}) FILTER (WHERE {_EXT} <> ''))), ','), '') AS file_types, count(*) AS processed_objects, CAST(sum(CAST(page_id % 10 = 0 AS INT)) AS BIGINT) AS flagged_objects FROM {_PATHS_SQL} GROUP BY package""",
)
def package_stats(spark, sf):
    from .sources.files import accepted

    f = paths(spark, sf).withColumn("accepted", accepted(F.col("extension")))
    o = f.select("package", F.when(F.col("page_id") % 10 == 0, 0.9).otherwise(0.1).alias("score"))
    return report.package_stats(f, o, "package", "accepted", "extension", "score").withColumn("file_types", F.array_join("file_types", ","))


@query("object_activities", f"SELECT doc_id, CASE WHEN v1 = 'LOAD_NAME foo' THEN '' ELSE substr(v1, 11) END AS activities FROM {_OBJ_SQL}")
def object_activities(spark, sf):
    o = objects.with_tokens(code_objects(spark, sf))
    return o.select("doc_id", F.array_join(report.object_activities(F.col("tokens"), F.col("language")), ",").alias("activities"))


@query("activities", f"SELECT DISTINCT source, substr(v1, 11) AS activity FROM {_SCORED_SQL} WHERE score > 0.2 AND v1 <> 'LOAD_NAME foo'")
def activities(spark, sf):
    o = scored(spark, sf).withColumn("a", report.object_activities(F.col("tokens"), F.col("language")))
    return report.activities(o, "source", "a", "score", 0.2)


@query("findings_by_file", f"SELECT source, path, string_agg('o' || CAST(doc_id % 5 AS STRING), ',' ORDER BY doc_id) AS names FROM {_SCORED_SQL} WHERE score > 0.2 GROUP BY source, path")
def findings_by_file(spark, sf):
    out = report.findings_by_file(scored(spark, sf), "source", "file_path", "name", "score", "doc_id", 0.2)
    return out.select("source", F.col("file_path").alias("path"), F.array_join("names", ",").alias("names"))


_CODE = "replace(replace(d.text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query("report_details", f"SELECT d.doc_id, score, CASE WHEN d.text IS NULL OR d.text = '' THEN NULL WHEN contains({_CODE}, chr(10)) THEN regexp_replace({_CODE}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE d.text END AS code FROM {_SCORED_SQL} s JOIN documents d USING (doc_id) WHERE score > 0.2")
def report_details(spark, sf):
    text = table(spark, sf, "documents").select("doc_id", "text")
    found = scored(spark, sf).where(report.flagged(F.col("score"), 0.2)).select("doc_id", "score", "instructions")
    code = objects.display_code(F.col("text"), F.col("instructions"))
    return found.join(text, "doc_id").select("doc_id", "score", code.alias("code"))


# ---- windows ----
_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda t: t <> '')"


def tokenised(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", dataset.split_tokens(F.col("text")).alias("tokens"))


@query("embedding_count", f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents")
def embedding_count(spark, sf):
    return tokenised(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n"))


def _windows_sql(last: str) -> str:
    return f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT doc_id, w, unnest(range(0, CAST(CASE WHEN n <= 512 THEN 0 ELSE {last} END AS BIGINT) + 1, 384)) AS a FROM x)
SELECT doc_id, CAST(a // 384 AS INT) AS window_index, CAST(a AS INT) AS start, CAST(len(w[a + 1 : a + 512]) AS INT) AS size, md5(array_to_string(w[a + 1 : a + 512], ' ')) AS digest FROM s"""


@query("infer_windows", _windows_sql("((n - 1) // 384) * 384"))
def infer_windows(spark, sf):
    return windows.windows(tokenised(spark, sf), "tokens").select("doc_id", "window_index", "start", F.size("window").alias("size"), F.md5(F.array_join("window", " ")).alias("digest"))


@query("train_windows", _windows_sql("ceil((n - 512) / 384) * 384"))
def train_windows(spark, sf):
    return windows.windows(tokenised(spark, sf), "tokens", training=True).select("doc_id", "window_index", "start", F.size("window").alias("size"), F.md5(F.array_join("window", " ")).alias("digest"))


@query("window_padding", f"SELECT doc_id, window_index, 512 AS size, CAST(size AS BIGINT) AS ones FROM ({_windows_sql('((n - 1) // 384) * 384')})")
def window_padding(spark, sf):
    w = windows.windows(tokenised(spark, sf), "tokens")
    return w.select("doc_id", "window_index", F.size(windows.padded(F.col("window"))).alias("size"), F.aggregate(windows.mask(F.col("window")), F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


_HALVES = [f"list_reduce(list_transform(embedding[{part}], lambda x: CAST(x AS DOUBLE)), lambda u, x: u + x)" for part in ("1 : len(embedding) // 2", "len(embedding) // 2 + 1 : len(embedding)")]
_LOGITS = f"(SELECT vec_id, label, {_HALVES[0]} AS a, {_HALVES[1]} AS b FROM embeddings)"


def logits(spark, sf) -> DataFrame:
    """Two logits of each vector: the sums of its halves."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda u, v: u + v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", total(F.slice("embedding", F.lit(1), half)).alias("a"), total(F.slice("embedding", half + 1, F.size("embedding") - half)).alias("b"))


@query("softmax_label", f"SELECT vec_id, round(1 - 1 / (1 + exp(a - b)), 6) AS p_benign, round(1 / (1 + exp(a - b)), 6) AS p_malicious, CASE WHEN b > a THEN 'Malicious' ELSE 'Benign' END AS label FROM {_LOGITS}")
def softmax_label(spark, sf):
    rows = logits(spark, sf)
    good, bad = windows.softmax2(F.col("a"), F.col("b"))
    return rows.select("vec_id", F.round(good, 6).alias("p_benign"), F.round(bad, 6).alias("p_malicious"), F.when(F.col("b") > F.col("a"), "Malicious").otherwise("Benign").alias("label"))


@query("best_window", f"SELECT label, p, vec_id, window_count FROM (SELECT label, round(b, 1) AS p, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(b, 1) DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS window_count FROM {_LOGITS}) WHERE r = 1")
def best_window(spark, sf):
    return windows.best_window(logits(spark, sf).withColumn("p", F.round("b", 1)), ["label"], "p", "vec_id").select("label", "p", "vec_id", "window_count")


# ---- data sets: labels.toxic is the class ----
_CLASS_SQL = "WITH x AS (SELECT d.doc_id, d.source, sha256(d.text) AS hash, coalesce(l.toxic, 0) AS y FROM documents d LEFT JOIN labels l USING (doc_id)), b AS (SELECT * FROM x WHERE y = 0), m AS (SELECT * FROM x WHERE y = 1)"


def classes(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "source", F.sha2("text", 256).alias("hash"), F.coalesce("toxic", F.lit(0)).alias("y"))
    return rows.where("y = 0"), rows.where("y = 1")


@query("dedupe_first", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(spark, sf):
    return dataset.dedupe_first(table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id"), "hash", ["doc_id"])


@query("common_hashes", _CLASS_SQL + " SELECT DISTINCT hash FROM b WHERE hash IN (SELECT hash FROM m)")
def common_hashes(spark, sf):
    return dataset.common_hashes(*classes(spark, sf), "hash")


@query("benign_wins", _CLASS_SQL + " SELECT hash, min(doc_id) AS doc_id, 0 AS label FROM b GROUP BY hash UNION ALL SELECT hash, min(doc_id), 1 FROM m WHERE hash NOT IN (SELECT hash FROM b) GROUP BY hash")
def benign_wins(spark, sf):
    good, bad = dataset.benign_wins(*classes(spark, sf), "hash", ["doc_id"])
    return dataset.label_union(good, bad).select("hash", "doc_id", "label")


@query("dedupe_stats", _CLASS_SQL + " SELECT (SELECT count(*) FROM b) AS benign_rows, (SELECT count(*) FROM m) AS malicious_rows, (SELECT count(DISTINCT hash) FROM b) AS benign_kept, (SELECT count(DISTINCT hash) FROM m WHERE hash NOT IN (SELECT hash FROM b)) AS malicious_kept, (SELECT count(DISTINCT hash) FROM m WHERE hash IN (SELECT hash FROM b)) AS shared")
def dedupe_stats(spark, sf):
    return dataset.dedupe_stats(*classes(spark, sf), "hash")


@query("union_enrich", _CLASS_SQL + " SELECT hash, min(doc_id) AS doc_id FROM x GROUP BY hash")
def union_enrich(spark, sf):
    good, bad = classes(spark, sf)
    return dataset.union_enrich(good.select("hash", "doc_id", "source"), bad.select("hash", "doc_id"), "hash", ["doc_id"]).select("hash", "doc_id")


@query("downsample_ratio", _CLASS_SQL + " SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || CAST(doc_id AS STRING)), doc_id) AS r FROM b) WHERE r <= CAST(floor((SELECT count(*) FROM m) * 2.5) AS BIGINT)")
def downsample_ratio(spark, sf):
    good, bad = classes(spark, sf)
    return dataset.downsample_ratio(good, bad, 2.5, ["doc_id"]).select("doc_id")


@query("stratified_split", _CLASS_SQL + " SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || CAST(doc_id AS STRING)), doc_id) <= ceil(count(*) OVER (PARTITION BY y) * 0.2) AS is_test FROM x")
def stratified_split(spark, sf):
    good, bad = classes(spark, sf)
    return dataset.stratified_split(good.unionByName(bad), "y", "doc_id").select("doc_id", "y", "is_test")


@query("label_union", _CLASS_SQL + " SELECT doc_id, 0 AS label FROM b UNION ALL SELECT doc_id, 1 FROM m")
def label_union(spark, sf):
    good, bad = classes(spark, sf)
    return dataset.label_union(good, bad).select("doc_id", "label")


@query(
    "binary_metrics",
    """WITH x AS (SELECT toxic = 1 AS y, quality = 0 AS p FROM labels), n AS (SELECT CAST(count(*) FILTER (WHERE y AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT y AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT y AND NOT p) AS DOUBLE) AS tn FROM x)
       SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM n""",
)
def binary_metrics(spark, sf):
    rows = table(spark, sf, "labels").select("toxic", (F.col("quality") == 0).cast("int").alias("p"))
    return scoring.binary_metrics(rows, "toxic", "p").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("chunk_rows", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS chunk FROM documents")
def chunk_rows(spark, sf):
    return dataset.chunk_rows(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


_EACH = f"SELECT doc_id, unnest({_WORDS}) AS token, generate_subscripts({_WORDS}, 1) AS i FROM documents"


@query("distinct_tokens", f"SELECT DISTINCT token FROM ({_EACH})")
def distinct_tokens(spark, sf):
    return table(spark, sf, "documents").select(F.explode(dataset.split_tokens(F.col("text"))).alias("token")).distinct()


@query("token_frequency", f"SELECT token, count(*) AS count FROM ({_EACH}) GROUP BY token")
def token_frequency(spark, sf):
    return dataset.token_frequency(table(spark, sf, "documents"), "text", "doc_id").select("token", "count")


_TOP_SQL = f"""WITH e AS ({_EACH}), c AS (SELECT token, count(*) AS count, min((doc_id, i)) AS first FROM e GROUP BY token)
SELECT token, coalesce(count, 0) AS count, true AS is_base FROM (SELECT unnest(['the', 'eval', 'exec']) AS token) LEFT JOIN c USING (token)
UNION ALL SELECT token, count, false FROM (SELECT * FROM c WHERE token NOT IN ('the', 'eval', 'exec') ORDER BY count DESC, first LIMIT 497)"""


@query("top_tokens", _TOP_SQL)
def top_tokens(spark, sf):
    return dataset.top_tokens(table(spark, sf, "documents"), "text", "doc_id", ["the", "eval", "exec"], 500)


@query("special_tokens", f"WITH s AS (SELECT unnest([{', '.join(map(S.q, fixed.FUNCTION_MAP['python']))}]) AS token) SELECT token, coalesce(n, 0) AS count FROM s LEFT JOIN (SELECT token, count(*) AS n FROM ({_EACH}) GROUP BY token) USING (token)")
def special_tokens(spark, sf):
    base = list(fixed.FUNCTION_MAP["python"])
    return dataset.top_tokens(table(spark, sf, "documents"), "text", "doc_id", base, len(base)).select("token", "count")


# ---- model results ----
_LEXICON, _BIAS, _LONGEST = {"the": 0.25, "and": -0.5, "de": 0.125, "la": -0.25, "der": 0.5, "und": -0.125}, 1.0, 60


@query(
    "prediction_status",
    f"""WITH t AS (SELECT doc_id, text, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE len(w) END, 384)) AS a FROM t WHERE len(w) > 0),
    v AS (SELECT doc_id, n, len(list_filter(w[a + 1 : a + 512], lambda y: length(y) > {_LONGEST})) > 0 AS bad, list_filter(list_transform(w[a + 1 : a + 512], lambda y: CASE y {" ".join(f"WHEN {S.q(k)} THEN {w}" for k, w in _LEXICON.items())} END), lambda y: y IS NOT NULL) AS k FROM x),
    r AS (SELECT doc_id, any_value(n) AS n, bool_or(bad) AS bad, count(*) FILTER (len(k) > 0) AS scored, max(1 / (1 + exp(-({_BIAS} + list_sum(k))))) FILTER (len(k) > 0) AS p FROM v GROUP BY doc_id),
    m AS (SELECT t.doc_id, CASE WHEN text IS NULL THEN 'Input_Error_Invalid_Text_Input_Type' WHEN r.doc_id IS NULL THEN 'Input_Error_Empty_After_Tokenization' WHEN bad THEN 'Inference_Err: a token has more than {_LONGEST} characters' WHEN scored = 0 AND n > 512 THEN 'Windowing_Error_No_Results' WHEN scored = 0 THEN 'No_Logits' END AS message, n, scored, p FROM t LEFT JOIN r USING (doc_id))
    SELECT doc_id, '1.2.3' AS release, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status, message, CASE WHEN message IS NULL THEN CASE WHEN p > 0.5 THEN 'Malicious' ELSE 'Benign' END END AS label, CASE WHEN message IS NULL THEN round(p, 6) END AS p_malicious, CAST(CASE WHEN message IS NULL AND n > 512 THEN scored ELSE 0 END AS INT) AS window_count FROM m
    UNION ALL SELECT doc_id, '9.9.9', 'error', CASE WHEN text IS NULL THEN 'Input_Error_Invalid_Text_Input_Type' ELSE 'Model_Not_Loaded' END, NULL, NULL, 0 FROM documents""",
)
def prediction_status(spark, sf):
    """The result of every document under two releases: one that a model serves, and one that none does."""
    store = inference.ModelStore(spark, shared_folder(spark, "models"))
    store.save("1.2.3", inference.LexiconModel(_LEXICON, _BIAS, _LONGEST))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = [inference.predict(docs, "text", store, release).withColumn("release", F.lit(release)) for release in ("1.2.3", "9.9.9")]
    p = F.col("prediction")
    return found[0].unionByName(found[1]).select("doc_id", "release", p["status"].alias("status"), p["message"].alias("message"), p["label"].alias("label"), F.round(p["p_malicious"], 6).alias("p_malicious"), p["window_count"].alias("window_count"))


# ---- triage ----
@query(
    "concat_by_group",
    r"""SELECT conv_id, md5(string_agg(chr(10) || '### FILE: ' || CAST(conv_id AS STRING) || '/' || lpad(CAST(turn AS STRING), 6, '0') || chr(10) || regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', '', 'g') || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def concat_by_group(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("g"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("path"), "text")
    return triage.concat_by_group(c, "g", "path", "text").select(F.col("g").cast("long").alias("conv_id"), F.md5("text").alias("digest"))


_DECIDED = "(SELECT conv_id, turn, (['benign', 'suspicious', 'malicious', 'benign', NULL])[1 + CAST((conv_id * 3 + turn) % 5 AS INT)] AS decision, role || CAST(turn AS STRING) AS reason FROM conversations)"


def decided(spark, sf) -> DataFrame:
    d = F.element_at(F.array(*map(F.lit, ["benign", "suspicious", "malicious", "benign", None])), ((F.col("conv_id") * 3 + F.col("turn")) % 5 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", d.alias("decision"), F.concat("role", F.col("turn").cast("string")).alias("reason"))


@query(
    "severity_rollup",
    f"""WITH d AS (SELECT *, CASE coalesce(decision, 'suspicious') WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END AS s FROM {_DECIDED}), m AS (SELECT *, max(s) OVER (PARTITION BY conv_id) AS top FROM d),
       r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM m WHERE s = top)
       SELECT conv_id, CASE max(s) WHEN 2 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'benign' END AS decision, string_agg(reason, '; ' ORDER BY turn) || CASE WHEN max(n) > 3 THEN ' and ' || CAST(max(n) - 3 AS STRING) || ' more' ELSE '' END AS reasoning FROM r WHERE k <= 3 GROUP BY conv_id""",
)
def severity_rollup(spark, sf):
    return triage.severity_rollup(decided(spark, sf), "conv_id", "decision", "reason", "turn")


@query("triage_summary", f"SELECT coalesce(decision, 'suspicious') AS decision, count(*) AS n FROM {_DECIDED} GROUP BY 1")
def triage_summary(spark, sf):
    return triage.triage_summary(decided(spark, sf), "decision")


@query("verdict_from_text", "SELECT doc_id, CASE WHEN json_valid(text) AND lower(json_extract_string(text, '$.decision')) IN ('malicious', 'suspicious', 'benign') THEN lower(json_extract_string(text, '$.decision')) WHEN contains(lower(text), 'malicious') THEN 'malicious' WHEN contains(lower(text), 'benign') THEN 'benign' ELSE 'suspicious' END AS decision FROM documents")
def verdict_from_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", triage.parse_reply(F.col("text")).alias("decision"))


_MODEL = "(['Mistral-large', 'gpt-4', 'claude-x', 'Meta-llama', 'gemini-pro', 'other', 'openai-mistral'])[1 + CAST(doc_id % 7 AS INT)]"


@query(
    "route_by_keyword",
    f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'http://own' WHEN contains(m, 'mistral') THEN 'https://api.mistral.ai/v1' WHEN contains(m, 'openai') OR contains(m, 'gpt') THEN 'https://api.openai.com/v1' WHEN contains(m, 'claude') OR contains(m, 'anthropic') THEN 'https://api.anthropic.com/v1'
        WHEN contains(m, 'llama') OR contains(m, 'meta') THEN 'https://api.together.xyz/v1' WHEN contains(m, 'gemini') OR contains(m, 'google') THEN 'https://generativelanguage.googleapis.com/v1' ELSE 'https://api.mistral.ai/v1' END AS url FROM (SELECT doc_id, lower({_MODEL}) AS m FROM documents)""",
)
def route_by_keyword(spark, sf):
    model = F.element_at(F.array(*map(F.lit, ["Mistral-large", "gpt-4", "claude-x", "Meta-llama", "gemini-pro", "other", "openai-mistral"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", triage.route_by_keyword(model, F.when(F.col("doc_id") % 11 == 0, "http://own").otherwise("")).alias("url"))


@query("prefer_first_by_type", "SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS r FROM conversations) WHERE r = 1")
def prefer_first_by_type(spark, sf):
    return triage.prefer_first_by_type(table(spark, sf, "conversations").select("conv_id", "role", "turn"), "conv_id", "role", "assistant", "turn")


@query("unique_names", "SELECT page_id, CASE WHEN r = 0 THEN n ELSE 'p' || CAST(page_id % 20 AS STRING) || '_' || CAST(r AS STRING) || '.html' END AS unique_name FROM (SELECT page_id, 'p' || CAST(page_id % 20 AS STRING) || '.html' AS n, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) - 1 AS r FROM pages)")
def unique_names(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("p"), (F.col("page_id") % 20).cast("string"), F.lit(".html")).alias("name"))
    return triage.unique_names(rows, "name", "page_id").select("page_id", "unique_name")


# ---- the compiler: one statement of each kind, with a name and a number of the document's text ----
#: language, source, and the listings of its objects; {h} is a name and {n} a number.
FORMS = [
    ("python", "{h} = {n}", "<module>: RESUME 0; LOAD_CONST {n}.0; STORE_NAME {h}; RETURN_CONST"),
    ("python", "import {h}", "<module>: RESUME 0; LOAD_CONST 0; LOAD_CONST; IMPORT_NAME {h}; STORE_NAME {h}; RETURN_CONST"),
    ("python", "{h}({n}, 'a')", "<module>: RESUME 0; PUSH_NULL; LOAD_NAME {h}; LOAD_CONST {n}.0; LOAD_CONST 'a'; CALL 2; POP_TOP; RETURN_CONST"),
    ("python", "x = [{h}, {n}]", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; BUILD_LIST 2; STORE_NAME x; RETURN_CONST"),
    ("python", "x = {'k': {h}}", "<module>: RESUME 0; LOAD_CONST 'k'; LOAD_NAME {h}; BUILD_MAP 1; STORE_NAME x; RETURN_CONST"),
    ("python", "x = {h}.y", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_ATTR y; STORE_NAME x; RETURN_CONST"),
    ("python", "x = {h}[{n}]", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; BINARY_SUBSCR; STORE_NAME x; RETURN_CONST"),
    ("python", "x = {h} + {n}", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; BINARY_OP 0; STORE_NAME x; RETURN_CONST"),
    ("python", "x = -{h}", "<module>: RESUME 0; LOAD_NAME {h}; UNARY_NEGATIVE; STORE_NAME x; RETURN_CONST"),
    ("python", "x = {h} < {n}", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; COMPARE_OP; STORE_NAME x; RETURN_CONST"),
    ("python", "x = not {h}", "<module>: RESUME 0; LOAD_NAME {h}; LOGICAL_NOT; STORE_NAME x; RETURN_CONST"),
    ("python", "if {h}:\n    f()\nelse:\n    g()", "<module>: RESUME 0; LOAD_NAME {h}; POP_JUMP_IF_FALSE 7; PUSH_NULL; LOAD_NAME f; CALL 0; POP_TOP; JUMP_FORWARD 11; PUSH_NULL; LOAD_NAME g; CALL 0; POP_TOP; RETURN_CONST"),
    ("python", "while {h}:\n    f()", "<module>: RESUME 0; LOAD_NAME {h}; POP_JUMP_IF_FALSE 5; PUSH_NULL; LOAD_NAME f; CALL 0; POP_TOP; JUMP_BACKWARD 7; RETURN_CONST"),
    ("python", "for i in {h}:\n    f(i)", "<module>: RESUME 0; LOAD_NAME {h}; GET_ITER; FOR_ITER 7; STORE_NAME i; PUSH_NULL; LOAD_NAME f; LOAD_NAME i; CALL 1; POP_TOP; JUMP_BACKWARD 8; END_FOR; RETURN_CONST"),
    ("python", "x = [i for i in {h}]", "<module>: RESUME 0; BUILD_LIST 0; LOAD_NAME {h}; GET_ITER; FOR_ITER 9; STORE_FAST i; LOAD_FAST i; LIST_APPEND 1; JUMP_FORWARD 4; STORE_NAME x; RETURN_CONST"),
    ("python", "x = lambda: {h}", "<module>: RESUME 0; MAKE_FUNCTION lambda_ref_0; STORE_NAME x; RETURN_CONST || lambda_ref_0: LOAD_GLOBAL {h}; RETURN_VALUE"),
    ("python", "x = f'a{{h}}'", "<module>: RESUME 0; LOAD_CONST a; LOAD_NAME {h}; FORMAT_VALUE; BUILD_STRING 2; STORE_NAME x; RETURN_CONST"),
    ("python", "x = 1 if {h} else {n}", "<module>: RESUME 0; LOAD_NAME {h}; POP_JUMP_IF_FALSE 5; LOAD_CONST 1.0; JUMP_FORWARD 6; LOAD_CONST {n}.0; STORE_NAME x; RETURN_CONST"),
    ("python", "class {h}:\n    y = {n}", "<module>: RESUME 0; PUSH_NULL; LOAD_BUILD_CLASS; LOAD_CONST CodeObject(name={h}_ref_0, path=x, location=(2, 2)); MAKE_FUNCTION 0; LOAD_CONST {h}; CALL 2; STORE_NAME {h}; RETURN_CONST || {h}_ref_0: LOAD_CONST {n}.0; STORE_NAME y"),
    ("javascript", "let {h} = {n};", "<module>: RESUME 0; LOAD_CONST {n}.0; STORE_NAME {h}; RETURN_CONST"),
    ("javascript", "{h}({n}, 'a');", "<module>: RESUME 0; PUSH_NULL; LOAD_NAME {h}; LOAD_CONST {n}.0; LOAD_CONST 'a'; CALL 2; POP_TOP; RETURN_CONST"),
    ("javascript", "x = {h} + {n};", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; BINARY_OP 0; STORE_NAME x; RETURN_CONST"),
    ("javascript", "while ({h}) { f(); }", "<module>: RESUME 0; LOAD_NAME {h}; POP_JUMP_IF_FALSE 5; PUSH_NULL; LOAD_NAME f; CALL 0; POP_TOP; JUMP_BACKWARD 7; RETURN_CONST"),
    ("javascript", "x = {h}.y;", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_ATTR y; STORE_NAME x; RETURN_CONST"),
    ("javascript", "x = [{h}, {n}];", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_CONST {n}.0; BUILD_LIST 2; STORE_NAME x; RETURN_CONST"),
    ("javascript", "x = typeof {h};", "<module>: RESUME 0; LOAD_NAME {h}; TYPEOF_OPERATOR; STORE_NAME x; RETURN_CONST"),
    ("javascript", "delete {h}.y;", "<module>: RESUME 0; LOAD_NAME {h}; LOAD_ATTR y; DELETE_OPERATOR; POP_TOP; RETURN_CONST"),
    ("javascript", "function {h}(a) { return a; }", "<module>: RESUME 0; LOAD_CONST CodeObject(name={h}_ref_0, path=x, location=(1, 1)); MAKE_FUNCTION 0; STORE_NAME {h}; RETURN_CONST || {h}_ref_0: LOAD_PARAM a; RETURN_VALUE"),
    ("javascript", "x = (a) => {h};", "<module>: RESUME 0; MAKE_FUNCTION lambda_ref_0; STORE_NAME x; RETURN_CONST || lambda_ref_0: LOAD_GLOBAL {h}; RETURN_VALUE"),
    ("javascript", "do { f(); } while ({h});", "<module>: RESUME 0; PUSH_NULL; LOAD_NAME f; CALL 0; POP_TOP; LOAD_NAME {h}; POP_JUMP_IF_TRUE -2; RETURN_CONST"),
]
_FORMS_SQL = f"""SELECT doc_id, split_part(o, ': ', 1) AS name, substr(o, length(split_part(o, ': ', 1)) + 3) AS listing FROM (
  SELECT doc_id, unnest(string_split(replace(replace(([{", ".join(S.q(listing) for _, _, listing in FORMS)}])[1 + doc_id % {len(FORMS)}], '{{h}}', 'n' || md5(coalesce(text, ''))), '{{n}}', CAST(1 + length(coalesce(text, '')) AS VARCHAR)), ' || ')) AS o FROM documents)"""


@query("compile_statements", _FORMS_SQL)
def compile_statements(spark, sf):
    """A statement about each document, of a kind that its number chooses: its name is the digest of the whole text, its number one more than the text's length."""
    from .operators.compile import compile_files

    text = F.coalesce("text", F.lit(""))
    of = lambda place: F.element_at(F.array(*[F.lit(f[place]) for f in FORMS]), (F.col("doc_id") % len(FORMS) + 1).cast("int"))
    source = F.replace(F.replace(of(1), F.lit("{h}"), F.concat(F.lit("n"), F.md5(text))), F.lit("{n}"), (F.length(text) + 1).cast("string"))
    files = spread(table(spark, sf, "documents")).select("doc_id", F.lit("x").alias("path"), of(0).alias("language"), source.alias("content"))
    out = compile_files(files, carry=["doc_id"])
    return out.select("doc_id", "name", F.array_join(F.transform("instructions", lambda i: F.concat_ws(" ", i["opcode"], F.when(i["arg_kind"] != "none", i["arg"]))), "; ").alias("listing"))


# ---- without SQL: the compiler, models, streams ----
@query("compile_objects", None)
def compile_objects(spark, sf):
    """Sources made from the documents' whole texts, in both languages, compiled to objects with tokens and hashes."""
    from .operators.compile import compile_groups

    # backslashes first, then what would end the literal in either language; other characters are kept as they are
    literal = F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\"))
    for mark, escape in (("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\x00"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        literal = F.replace(literal, F.lit(mark), F.lit(escape))
    literal = F.concat(F.lit("'"), F.coalesce(literal, F.lit("")), F.lit("'"))
    python = F.concat(F.lit("import os\ndef f(x):\n    return eval(x + "), literal, F.lit(")\nprint(f('a'))\n"))
    script = F.concat(F.lit("const os = require('os');\nfunction f(x) { return eval(x + "), literal, F.lit("); }\nconsole.log(f('a'));\n"))
    path, text = F.concat(F.lit("p/"), F.col("doc_id").cast("string")), F.coalesce("text", F.lit(""))
    # each text as a literal in both languages, and as a source of its own, mostly of broken syntax
    kinds = [("py", "python", python), ("js", "javascript", script), ("text.py", "python", text), ("text.js", "javascript", text)]
    each = F.explode(F.array(*[F.struct(F.concat(path, F.lit(f".{end}")).alias("path"), F.lit(lang).alias("language"), code.alias("content")) for end, lang, code in kinds]))
    files = spread(table(spark, sf, "documents").select("doc_id", "text")).select(each.alias("f")).select("f.*")
    return objects.tokens_of_groups(compile_groups(files))


@query("train_model", None)
def train_model(spark, sf):
    """Logistic regression of toxic on the whole texts' words, and its prediction for each document."""
    words = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", dataset.split_tokens(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    # counted once, before the join and for all passes: what is stored and moved are counts, not texts
    counted = scoring.hashed_counts(words, "tokens", 1 << 12).select("doc_id", "__tf").join(labels, "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(0))).where("y IN (0, 1)")
    counted = written(counted, "counts")
    model = scoring.fit_counts(counted, "y", maxIter=20, regParam=0.01)
    return model.transform(counted).select("doc_id", "y", F.col("prediction").cast("int").alias("predicted"))


@query("stream_dedupe", "SELECT hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS hash FROM documents) GROUP BY hash")
def stream_dedupe(spark, sf):
    from .streaming.jobs import first_by_hash

    return first_by_hash(spark, f"{sf}/documents.parquet")


@query("bpe_vocab", None)
def bpe_vocab(spark, sf):
    tokenizer = dataset.bpe_vocabulary(table(spark, sf, "documents"), "text", 2000, objects.special_tokens("python"))
    return spark.createDataFrame(sorted(tokenizer.get_vocab().items()), "token string, id long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
