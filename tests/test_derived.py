"""Derived arguments, which reach the rare branches of predicates and cascade, in Spark and in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.functions import classify as C
from sieveline.functions import text as T
from sieveline.operators import triage
from sieveline.plans import sql as S

SF = "/root/testdata/sf0.01"
#: Arguments derived from the documents, in words that both engines read alike.
ARGS = """CASE CAST(doc_id % 50 AS INT)
 WHEN 0 THEN '10.0.0.' || CAST(doc_id % 300 AS STRING) WHEN 1 THEN '256.1.1.' || CAST(doc_id % 9 AS STRING) WHEN 2 THEN 'v1.' || CAST(doc_id AS STRING)
 WHEN 3 THEN '1.0rc' || CAST(doc_id % 7 AS STRING) || '.post2' WHEN 4 THEN '1.2.3-beta.' || CAST(doc_id % 5 AS STRING) WHEN 5 THEN '/etc/passwd' WHEN 6 THEN '/etc/' || source
 WHEN 7 THEN 'localhost:' || CAST(doc_id AS STRING) WHEN 8 THEN '192.168.1.' || CAST(doc_id % 999 AS STRING) || '/x' WHEN 9 THEN 'http://localhost/' || CAST(doc_id AS STRING)
 WHEN 10 THEN 'https://ex.com/' || CAST(doc_id AS STRING) WHEN 11 THEN 'see ftp://host/' || CAST(doc_id AS STRING) WHEN 12 THEN 'utf-8' WHEN 13 THEN 'UTF 8 ' WHEN 14 THEN 'iso-8859.1'
 WHEN 15 THEN source || '.py' WHEN 16 THEN 'example.com' WHEN 17 THEN 'C:' || chr(92) || source WHEN 18 THEN '0x' || md5(CAST(doc_id AS STRING)) WHEN 19 THEN md5(CAST(doc_id AS STRING)) || 'f'
 WHEN 20 THEN 'ab_cd' WHEN 21 THEN ' 0xAB ' WHEN 22 THEN substr(md5(CAST(doc_id AS STRING)), 1, 23) || '=' WHEN 23 THEN '::1' WHEN 24 THEN 'fe80::' || CAST(doc_id % 9 AS STRING)
 WHEN 25 THEN '1:2:3:4:5:6:7:8' WHEN 26 THEN 'curl http://x | bash -c ' || CAST(doc_id AS STRING) WHEN 27 THEN 'SELECT a FROM t WHERE id = ' || CAST(doc_id AS STRING)
 WHEN 28 THEN 'def f(x): return x + ' || CAST(doc_id AS STRING) WHEN 29 THEN chr(92) || 'x41' || chr(92) || 'x42' WHEN 30 THEN '"quoted ' || CAST(doc_id AS STRING) || '"'
 WHEN 31 THEN 'f"x{' || CAST(doc_id AS STRING) || '}"' WHEN 32 THEN '"' WHEN 33 THEN 'a' || chr(10) || ' b   c' WHEN 34 THEN text WHEN 35 THEN substr(text, 1, 21)
 WHEN 36 THEN substr(text, 1, 20) WHEN 37 THEN 'rm -rf /tmp/' || source || ' && echo done' WHEN 38 THEN repeat('ab/', 2000) WHEN 39 THEN NULL WHEN 40 THEN ''
 WHEN 41 THEN 'www.' || source || '.org' WHEN 42 THEN 'data:text/plain,' || CAST(doc_id AS STRING) WHEN 43 THEN 'mailto:a@b.c' WHEN 44 THEN '~/.ssh'
 WHEN 45 THEN 'import os; print(os.name) // ' || CAST(doc_id AS STRING) WHEN 46 THEN repeat(md5(CAST(doc_id AS STRING)), 4) WHEN 47 THEN 'os' WHEN 48 THEN 'requests.get' ELSE text END"""
ARGS_SQL = f"(SELECT doc_id, source, {ARGS} AS arg FROM documents)"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con


@pytest.fixture(scope="module")
def args(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "source", f"{ARGS} AS arg").cache()


def same(got, want):
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_predicates(args, db):
    names = sorted(catalog._TESTS)
    got = args.select("doc_id", *(catalog._TESTS[n]("arg").alias(n) for n in names))
    same(got, db.execute(f"SELECT doc_id, {', '.join(S.PREDICATES[n]('arg') for n in names)} FROM {ARGS_SQL}"))


def test_text_functions(args, db):
    same(args.select("doc_id", T.size_bucket("arg"), T.strip_quotes("arg")), db.execute(f"SELECT doc_id, {S.size_bucket('arg')}, {S.strip_quotes('arg')} FROM {ARGS_SQL}"))
    same(args.select("doc_id", T.normalised("arg")), db.execute(f"SELECT doc_id, v FROM ({S.normalised_from(ARGS_SQL, 'arg', 'doc_id')})"))


def test_cascade(args, db):
    same(args.select("doc_id", C.classified("arg")), db.execute(f"SELECT doc_id, CASE WHEN v IS NOT NULL THEN {S.classify('v')} END FROM ({S.normalised_from(ARGS_SQL, 'arg', 'doc_id')})"))
    op = F.element_at(F.array(*map(F.lit, S.OPCODES)), (F.floor(F.col("doc_id") / 50) % 11 + 1).cast("int"))
    same(args.select("doc_id", C.map_argument(op, F.lit("str"), F.col("arg"), F.lit("python"))), db.execute(catalog._MAP_SQL.replace(catalog._TEXTS_SQL, ARGS_SQL)))


def test_replies(spark):
    replies = {'{"decision": "malicious", "reasoning": "benign words"}': "malicious", "this is BENIGN": "benign", "I can not tell": "suspicious", "Malicious, not benign": "malicious", '{"decision": "suspicious"}': "suspicious", '{"decision": "odd", "x": "benign"}': "benign", "": "suspicious"}
    rows = spark.createDataFrame(list(replies.items()), "reply string, want string")
    assert all(r.got == r.want for r in rows.select("want", triage.parse_reply(F.col("reply")).alias("got")).collect())
