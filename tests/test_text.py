"""Predicates against the standard library, and the cascade by tables."""

import codecs
import re
import socket

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from sieveline.functions import classify as C
from sieveline.functions import fixed
from sieveline.functions import text as T

STRINGS = [
    None, "", " ", "1", "1.2.3", "v1.0", "1.0rc1", "1.0.dev0", "1.0+local.1", "1..2", "01.2.3.4", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "1::", "fe80::1", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1::2::3", "fe80::1%eth0", "12345::", "utf-8", "UTF_8", "utf 8", "latin-1", "iso-8859-1", "iso8859.1",
    "hex", "base64", "no-such", "ascii", "aliases", "-utf-8-", "ab", "abc", "0xab", "0xABC", "0x0xab", "a_bc", "a__b", "+a", " ab ", "-0", "0x", "g0", "YWJj", "YWI=", "YQ==", "Y===", "a\nb", "localhost", " LOCALHOST ", "localhost:1",
    "local", "10.1.2.3x", "192.168.0.1", "172.15.0.1", "172.16.0.1", "x http://localhost", "http://a", "http://", "ftp://x/y", "www.", "http.x", "x.y", "a:b", "HTTP://[::1]/x", "data:text/plain", "see https://x", "file.py", "a/b.TXT", "a/b", "example.com",
    "x.y.com", "/x", "~", "./a", "../a", "C:\\x", "c:/x", "1:/x", "\\\\srv", "a\\b.c", "x /usr/ y", "mailto:a.py", "\\x41\\x42", "\\x4", "a" * 20, "b" * 21, "c" * 100, "d" * 101, "e" * 1000, "f" * 1001, "5" * 5001,
]


def column(spark, f, strings=STRINGS):
    rows = spark.createDataFrame(list(enumerate(strings)), "i int, s string").select("i", f(F.col("s")).alias("v")).collect()
    return [v for _, v in sorted((r.i, r.v) for r in rows)]


def ip(s):
    if not s or "%" in s:
        return False
    for kind in (socket.AF_INET, socket.AF_INET6):
        try:
            socket.inet_pton(kind, s)
            return True
        except OSError:
            pass
    return False


def version(s):
    try:
        return bool(s) and "." in s and bool(Version(s))
    except InvalidVersion:
        return False


def encoding(s):
    try:
        return bool(s) and bool(codecs.lookup(s))
    except LookupError:
        return False


def hexadecimal(s):
    if not s or not s.strip():
        return False
    s = s[2:] if s.lower().startswith("0x") else s
    try:
        return bool(s) and len(s) % 2 == 0 and int(s, 16) is not None
    except ValueError:
        return False


@pytest.mark.parametrize(
    "column_of, truth",
    [
        (T.is_ip, ip), (T.is_version, version), (T.is_encoding, encoding), (T.is_hex, hexadecimal), (T.is_base64, lambda s: bool(s) and len(s) % 4 == 0 and bool(re.match(r"^[A-Za-z0-9+/]*(={0,2})$", s))),
        (T.is_escaped_hex, lambda s: bool(s) and bool(re.match(r"^(?:\\x[0-9a-fA-F]{2})+$", s))), (T.is_large_payload, lambda s: bool(s) and len(s) > 5000),
    ],
)
def test_against_library(spark, column_of, truth):
    got, want = column(spark, column_of), [truth(s) for s in STRINGS]
    assert [(s, g) for s, g, w in zip(STRINGS, got, want) if g != w] == []


@pytest.mark.parametrize(
    "column_of, yes",
    [
        (T.is_localhost, {"localhost", " LOCALHOST ", "localhost:1", "local", "10.1.2.3x", "192.168.0.1", "172.16.0.1", "x http://localhost", "::1"}),
        (T.is_url, {"http://a", "ftp://x/y", "www.", "http.x", "HTTP://[::1]/x"}),
        (T.contains_url, {"http://a", "ftp://x/y", "x http://localhost", "data:text/plain", "see https://x", "HTTP://[::1]/x"}),
        (T.is_file_path, {"file.py", "a/b.TXT", "/x", "./a", "../a", "C:\\x", "c:/x", "\\\\srv", "a\\b.c", "x /usr/ y"}),
    ],
)
def test_tables(spark, column_of, yes):
    got = {s for s, v in zip(STRINGS, column(spark, column_of)) if v}
    assert got - {"http://"} == yes or got == yes


def test_normalisation(spark):
    cases = {'"a"': "a", "'a'": "a", 'f"a"': "a", "f'a'": "a", '"""a"""': '""a""', '"': "", "a": "a", "'a\"": "'a\"", "": ""}
    assert column(spark, T.strip_quotes, list(cases)) == list(cases.values())
    assert column(spark, T.normalised, [" a \n b\r\n  c ", '"x\n y"', None]) == ["a b c", "x y", None]
    assert column(spark, T.size_bucket, ["a" * n for n in (20, 21, 100, 101, 1000, 1001)]) == ["", "STRING_SIZE_S", "STRING_SIZE_S", "STRING_SIZE_M", "STRING_SIZE_M", "STRING_SIZE_L"]


def test_code_kinds(spark):
    assert column(spark, T.is_bash, ["curl http://x | sh", "rm -rf /", "plain words", "x" * 50_001 + "curl x", None, "édo x"]) == [True, True, False, False, False, False]
    assert column(spark, T.is_code, ["def f(x): return x", "hello there", "a(b", "x = { 'a': 1", "if (x) y"])[:2] == [True, False]
    assert column(spark, T.is_sql, ["SELECT a FROM b WHERE c = 1", "select the one", "drop table x ", "UNION SELECT"]) == [True, False, True, True]


def test_cascade(spark):
    cases = {
        "/etc/passwd": "STRING_SENSITIVE_FILE_PATH", "local": "STRING_LOCALHOST", "8.8.8.8": "STRING_IP", "http://x": "STRING_URL", "a http://xy": "STRING_CONTAINS_URL", "1.2": "STRING_VERSION", "hex": "STRING_ENCODING",
        "a.py": "STRING_FILE_PATH", "short one": "short one", "curl somewhere | sh and more": "STRING_BASH STRING_SIZE_S", "ab" * 11: "STRING_HEX STRING_SIZE_S", "abcg" * 6: "STRING_BASE64 STRING_SIZE_S", "zz yy " * 30: "STRING STRING_SIZE_M",
    }
    assert column(spark, lambda c: C.classify_string(T.normalised(c)), list(cases)) == list(cases.values())


def test_map_argument(spark):
    none = []
    rows = [
        ("LOAD_CONST", "none", None, none), ("LOAD_CONST", "bool", "False", none), ("LOAD_CONST", "bool", "True", none), ("LOAD_CONST", "int", "0", none), ("LOAD_CONST", "int", "7", none), ("LOAD_CONST", "float", "0.0", none),
        ("LOAD_CONST", "float", "1.5", none), ("LOAD_CONST", "str", "", none), ("LOAD_CONST", "tuple", "()", none), ("LOAD_CONST", "tuple", "(..)", [("str", "b"), ("str", "a"), ("int", "1")]), ("LOAD_CONST", "tuple", "(None,)", [("none", None)]),
        ("POP_JUMP_IF_FALSE", "int", "9", none), ("JUMP_BACKWARD", "int", "9", none), ("MAKE_FUNCTION", "str", "f", none), ("IMPORT_NAME", "str", "os", none), ("IMPORT_NAME", "str", "numpyx", none), ("LOAD_NAME", "str", "eval", none),
        ("LOAD_ATTR", "str", "eval", none), ("CALL", "int", "2", none), ("POP_TOP", "str", "x", none), ("COPY", "int", "1", none), ("KW_NAMES", "tuple", "('a', 'b')", [("str", "a"), ("str", "b")]), ("LOAD_CONST", "str", '"utf-8"', none),
    ]
    want = [
        "LOAD_CONST", "LOAD_CONST", "LOAD_CONST BOOLEAN", "LOAD_CONST", "LOAD_CONST INTEGER", "LOAD_CONST", "LOAD_CONST FLOAT", "LOAD_CONST", "LOAD_CONST", "LOAD_CONST INTEGER a b", "LOAD_CONST LIST", "POP_JUMP_IF_FALSE", "JUMP_BACKWARD 9",
        "MAKE_FUNCTION", "IMPORT_NAME SYSTEM_INTERACTION", "IMPORT_NAME numpyx", "LOAD_NAME DYNAMIC_CODE_EXECUTION", "LOAD_ATTR eval", "CALL 2", "POP_TOP", "COPY 1", "KW_NAMES a b", "LOAD_CONST STRING_ENCODING",
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, op string, kind string, arg string, items array<struct<kind:string,text:string>>")
    got = df.select("i", C.map_argument(F.col("op"), F.col("kind"), F.col("arg"), F.lit("python"), F.col("items")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_tables_of_names():
    assert fixed.FUNCTION_MAP["python"]["os.execvpe"] == "PROCESS_REPLACEMENT"
    assert fixed.FUNCTION_MAP["python"]["requests.get"] == "NETWORK_HTTP_REQUEST" and fixed.FUNCTION_MAP["python"]["get"] == "ENVIRONMENT_VARIABLE_ACCESS"
    assert fixed.IMPORT_MAP["javascript"]["node:fs"] == "FILESYSTEM"
