"""Objects compiled in groups: the same tokens as one by one, at a cost that follows the words of a text."""

import ast

import pytest
from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.functions import fixed
from sieveline.operators import compile_script, objects, recover_python
from sieveline.operators.compile import compile_files, compile_groups, compile_source, plain_tokens

PROSE = "The quick brown fox. Jumps, over this lazy dog in éclair for now; it's\nof course " * 20


def test_groups_have_the_tokens_of_objects(spark):
    words = ["eval", "utf8", "UTF_8", "hex", "_hex_", "éhexé", "local", "LocalHost", "loopback", "a" * 20, "a" * 21, "é" * 20, "é" * 21, "ÿ", "x1", "$a", "µ", "ſ", "ı", "K", "select", "os", "require", "Iso8859_1", "base64", "punycode"]
    words += [n.swapcase() for n in fixed.ENCODINGS[::9] if n.isidentifier()] + sorted(fixed.FUNCTION_MAP["python"])[::40]
    sources = [PROSE, "", None, "def (:", " ".join(words), ". ".join(words), "\n".join(words), ";".join(f"{w} = {w}(1, 0, 0.0, True, 'x', '', None)" for w in words), "import os, base64\nfrom a import b as c, d\n", "class A {m(a) { return a in b }}\nx = `${a}`; this", "x = ('a', 1)\nf(k=1)\n", "x" * 600_000]
    rows = [(f"{name}{i}", language, s) for i, s in enumerate(sources) for language, name in (("python", "p/"), ("javascript", "p/"), ("rust", "p/"))] + [("p/setup.py", "python", "import os\nos.system('x')\n"), (None, None, "x")]
    files = spark.createDataFrame(rows, "path string, language string, content string").coalesce(2)
    want = objects.with_tokens(compile_files(files)).select("file_path", "name", F.size("instructions").alias("n"), "token_string", "hash")
    got = objects.tokens_of_groups(compile_groups(files))
    assert got.schema.simpleString() == want.schema.simpleString()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_plain_words_are_said_without_the_cascade():
    said = lambda word: plain_tokens(("LOAD_NAME", "str", word, ()))
    assert said("fox") == "LOAD_NAME fox" and said("élan") == "LOAD_NAME élan" and plain_tokens(("POP_TOP", "none", None, ())) == "POP_TOP"
    assert [said(w) for w in ("eval", "utf8", "Local", "a.b", "a" * 21, "1", "", "éhexé")] == [None] * 8
    assert plain_tokens(("LOAD_CONST", "str", "fox", ())) is None and plain_tokens(("IMPORT_NAME", "str", "fox", ())) is None


def test_prose_costs_no_parser_and_no_call_for_each_word(monkeypatch):
    asked, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: asked.append(a) or parse(*a, **k))
    prose = "Hewh and onon the. Ontion as thatndou, antiing\n" * 200
    with pytest.raises(SyntaxError):
        recover_python.recovered(prose)
    assert len(asked) < 5
    calls, statement = [], compile_script.ScriptFrontend.statement
    monkeypatch.setattr(compile_script.ScriptFrontend, "statement", lambda self: calls.append(1) or statement(self))
    found = compile_script.ScriptFrontend("x", prose).compile()
    assert len(calls) < 5 and len(found[0]["instructions"]) > 2000


def test_prose_runs_are_what_statements_make_of_them():
    def listing(source):
        return ["; ".join(f"{i['opcode']} {i['arg']}" if i["arg_kind"] != "none" else i["opcode"] for i in o["instructions"]) for o in compile_source("x", source, "javascript")]

    assert listing("a b, c.d in e f; this g.") == ["RESUME 0; LOAD_NAME a; POP_TOP; LOAD_NAME b; LOAD_NAME c; LOAD_ATTR d; LOAD_NAME e; COMPARE_IN; POP_TOP; LOAD_NAME f; POP_TOP; POP_TOP; LOAD_NAME g; POP_TOP; RETURN_CONST"]
    assert listing("a b(c) d = e f: g ") == ["RESUME 0; LOAD_NAME a; POP_TOP; PUSH_NULL; LOAD_NAME b; LOAD_NAME c; CALL 1; POP_TOP; LOAD_NAME e; STORE_NAME d; LOAD_NAME g; POP_TOP; RETURN_CONST"]
    assert listing("function f(a) { a b }")[1] == "LOAD_PARAM a; POP_TOP; LOAD_GLOBAL b; POP_TOP"
    # a body's last statement decides whether the arrow's own value is taken off
    assert listing("f(() => { x = 1; foo })")[0].endswith("CALL 1; POP_TOP; RETURN_CONST")


def test_hopeless_is_never_said_of_what_parses():
    for source in ("match x:\n  case 1: pass", "type A = int", "a if b else c", "x = u'a b'", "print a", "exec a", "not a", "a is not b", "lambda x: x", "1.e5if x else y", "# a b", "async def f(): pass", "'a b'", "x \\\n+ y", "case = 1", "_ = 1", "from a import b", "`a`"):
        assert not recover_python.hopeless(source), source
    assert recover_python.hopeless("The quick") and recover_python.hopeless("in the box") and not catalog.oracle_sql().get("compile_objects")
