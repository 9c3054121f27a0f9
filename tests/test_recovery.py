"""Sources that the language rejects: what can be saved of them is compiled."""

import random

import pytest

from sieveline.operators.compile import compile_source
from sieveline.operators.recover_python import blocks, modern, recovered, shallow


def ops(source):
    return [f"{i['opcode']} {i['arg']}" for o in compile_source("x", source, "python") for i in o["instructions"]]


@pytest.mark.parametrize("old, new", [
    ("print 'x'", "print('x')"), ("print", "print()"), ("print a, b", "print(a, b)"), ("print >>f, a", "print(a, file=f)"), ("print('x')", "print('x')"), ("x = print", "x = print()"),
    ("exec code in ns", "exec(code, ns)"), ("exec 'a = 1'", "exec('a = 1')"), ("exec(code)", "exec(code)"), ("except E, e:", "except E as e:"), ("except (A, B), e:", "except (A, B) as e:"),
    ("raise E, 'y'", "raise E('y')"), ("a <> b", "a != b"), ("`a`", "repr(a)"), ("0777", "0o777"), ("10L", "10"), ("ur'x'", "r'x'"), ("'print x; a <> b'", "'print x; a <> b'"), ("0.5", "0.5"), ("print 'a'; x = 0", "print('a'); x = 0"),
])
def test_statements_of_the_old_language(old, new):
    assert modern(old) == new


def test_sources_with_errors_are_compiled():
    # the rest of a line, of a file, of a class; unfinished strings and brackets
    assert "LOAD_ATTR system" in ops("print 'x'; import os; os.system('y')")
    assert "LOAD_ATTR system" in ops("import os\nthis is not python at all !!\nos.system('x')\n")
    assert "LOAD_GLOBAL eval" in ops("class A:\n  def m(self):\n    x = = 3\n    return eval(x)\n  def n(self):\n    return 2\n")
    assert "IMPORT_NAME os" in ops("s = \"unterminated\nimport os\n") and "IMPORT_NAME os" in ops("x = (1,\nimport os\n")
    assert "LOAD_NAME eval" in ops("}{ junk ; eval('1')")
    deep = ops("x = " + "[" * 300 + "1" + "]" * 300 + "\nimport os\n")
    assert "BUILD_LIST 1" in deep and "IMPORT_NAME os" in deep
    # lines keep their numbers
    found = compile_source("x", "???\n\ndef f():\n    print 'a'\n", "python")
    assert [(o["name"], o["start"], o["warnings"]) for o in found] == [("<module>", 1, []), ("f_ref_0", 3, [])]


def test_sources_without_anything_to_save():
    for source in ("def (:", "???", "\x01\x02", "((((", "x = = 3"):
        found = compile_source("x", source, "python")
        assert len(found) == 1 and found[0]["warnings"] == ["MALFORMED_SYNTAX"] and found[0]["instructions"] == []


def test_any_source_is_compiled_or_refused():
    r = random.Random(1)
    parts = ["print 'x'", "(", ")", "\n", " ", "    ", "def f():", "import os", "'", '"', "\'\'\'", ";", "=", "x", "\\", "#", "[", "é", "\r", "if x:", "else:", "class A:"]
    for _ in range(300):
        source = "".join(r.choice(parts) for _ in range(r.randint(0, 80)))
        assert compile_source("x", source, "python")
        lines = source.split("\n")
        assert [n for a, b in blocks(lines) for n in range(a, b)] == list(range(len(lines)))
    assert shallow("(" * 200 + ")" * 200) == "(" * 150 + ")" * 150
    with pytest.raises(SyntaxError):
        recovered("???")


@pytest.mark.parametrize("n", [60, 1000])
def test_any_number_of_bad_lines_hides_nothing(n):
    assert "LOAD_GLOBAL eval" in ops("class A:\n  def m(self):\n" + "    x = = 3\n" * n + "    return eval(x)\n")
    # bad lines in a class, an unfinished head behind its method
    assert "LOAD_ATTR system" in ops("class A:\n" + "  ??? !\n" * n + "  def k(self, y):\n    os.system(y)\n  else\n")
    # brackets that are never closed, and branches of the old language
    found = ops("try:\n" + "  foo(\n" * n + "  eval(1)\nexcept E, e:\n  exec 'x'\nelse:\n  k = = 3\n")
    assert "LOAD_NAME eval" in found and "LOAD_NAME exec" in found
    found = compile_source("x", "def f(:\n  eval(1)\n" + "??\n" * n + "def g():\n  exec(y)\n", "python")
    assert {o["name"].split("_")[0] for o in found} >= {"f", "g"}


def test_calls_nested_beyond_the_parser_stay():
    found = ops("x = " + "f(" * 400 + "eval('y')" + ")" * 400 + "\nimport os\n")
    assert found.count("LOAD_NAME f") == 400 and "LOAD_NAME eval" in found and "IMPORT_NAME os" in found
    found = ops("x = " + "[g(\n" * 160 + "eval('y')" + ")]" * 160 + "\nimport os\n")
    assert found.count("LOAD_NAME g") == 160 and "LOAD_NAME eval" in found and "IMPORT_NAME os" in found


@pytest.mark.parametrize("source", ["for (a", "function f(", "const {a", "let [a", "class A {", "class A { m(", "switch (x", "for (x of y", "`${a", "x = {", "try {", "=>", "a ? b"])
def test_unfinished_scripts_are_compiled(source):
    found = compile_source("x", f"eval(1);\n{source}", "javascript")
    assert found[0]["warnings"] == [] and any(i["arg"] == "eval" for i in found[0]["instructions"])


def test_any_script_is_compiled():
    r = random.Random(3)
    parts = "for ( a of [ { } ) ] class A function f switch x case : ; = , => ` ${ ' \" / let const try catch finally if else while do import export from * ... async await new . 1 + ++ label: return yield get set static # @ \n".split(" ")
    for _ in range(3000):
        assert compile_source("x", " ".join(r.choice(parts) for _ in range(r.randint(0, 40))), "javascript")[0]["warnings"] == []
