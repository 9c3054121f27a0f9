"""The cascade's patterns, taken apart for speed, against the fixed ones; each step of it is in the plan once."""

import random

from pyspark.sql import functions as F

from sieveline.functions import classify as C
from sieveline.functions import fixed
from sieveline.functions import text as T


def test_a_text_is_normalised_once(spark):
    df = spark.createDataFrame([("a",)], "s string")
    plan = df.select(C.classified("s").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_patterns_taken_apart_find_what_the_fixed_ones_find(spark):
    r = random.Random(5)
    words = "curl nc netcat find fi do done then if [ ]; #!/bin/sh $( ${x $PATH $é && | def f class lambda x: => from import console.a print ( == // /* */ <div > {a: { } .a{ #b{ [1 [\" select from where insert into update set delete order by union = x é".split()
    folded = {"s": "ſ", "k": "K", "i": "ı"}

    def word():
        w = r.choice(words)
        return "".join(folded.get(c, c) for c in w) if r.random() < 0.1 else w.upper() if r.random() < 0.1 else w

    rows = ["".join(word() + r.choice([" ", " ", "", "\n", " ", ";"]) for _ in range(r.choice([1, 2, 3, 6, 12]))) for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in [*rows, "", None]], "s string")
    c = F.col("s")

    def whole(text, least, marks, pattern):
        return F.coalesce((F.length(c) >= least) & (F.length(c) <= fixed.REGEX_LENGTH) & T._holds(text, marks) & c.rlike(pattern), F.lit(False))

    for name, old, new in (
        ("bash", whole(c, 2, fixed.BASH_MARKS, f"(?Uimd)({fixed.BASH_PATTERN})"), T.is_bash(c)), ("code", whole(c, 3, fixed.CODE_MARKS, f"(?Uimd)({fixed.CODE_PATTERN})"), T.is_code(c)),
        ("sql", whole(F.lower(c), 6, fixed.SQL_MARKS, rf"(?Uid)\b{fixed.SQL_PATTERN}\b"), T.is_sql(c)), ("blanks", F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), T.reduce_whitespace(c)),
    ):
        assert df.where(~old.eqNullSafe(new)).limit(3).collect() == [], name
        assert name == "blanks" or 0 < df.where(new).count() < df.count(), name


def test_every_codec_is_an_encoding_with_any_separator(spark):
    names = [*fixed.ENCODINGS, *(n.replace("_", "-") for n in fixed.ENCODINGS), *(f" {n.upper()}__" for n in fixed.ENCODINGS)]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert df.where(~T.is_encoding("s")).collect() == []
    others = spark.createDataFrame([(n,) for n in ("ansi.x3.4.1968", "iso8859.1", "utf..8", ".utf8", "ansi_x3.4.1968", "xutf8")], "s string")
    assert [x.e for x in others.select(T.is_encoding("s").alias("e")).collect()] == [True, True, False, False, True, False]


def test_one_scan_finds_the_words_of_all_three_languages(spark):
    r = random.Random(6)
    words = [w for ends in (T._SHELL_ENDS, T._CODE_ENDS, T._SQL_ENDS) for w in ends] + "from set into by table = ( .a : x é _ 7 - K ſ 😀 i̇".split()
    folded = {"s": "ſ", "k": "K", "i": "ıİ"}
    word = lambda: "".join(r.choice(folded.get(c, c)) if r.random() < 0.05 else r.choice((c, c, c, c.upper())) for c in r.choice(words))
    rows = ["".join(word() + r.choice([" ", " ", " ", "", "\n", "\t", "(", "."]) for _ in range(r.choice([1, 2, 3, 6]))) for _ in range(20_000)]
    # too long for patterns, and just not
    rows += [w + " x" + "." * (n - len(w) - 2) for n in (fixed.REGEX_LENGTH, fixed.REGEX_LENGTH + 1) for w in ("curl", "return", "delete from")]
    df = spark.createDataFrame([(x,) for x in [*rows, "", "a", None]], "s string")
    df = df.select("s", F.lower("s").alias("low"), F.length("s").alias("n"), T.words_said("s").alias("said"))
    s, low, n, said = (F.col(k) for k in df.columns)
    for name, old, new in (
        ("bash", T.is_bash(s), T.is_bash(s, said, n)), ("code", T.is_code(s), T.is_code(s, said, n)), ("sql", T.is_sql(s, low), T.is_sql(s, low, said, n)),
        ("hex", T.is_hex(s), T.is_hex(s, n)), ("base64", T.is_base64(s), T.is_base64(s, n)), ("url", T.contains_url(s), T.contains_url(s, low, n)), ("path", T.is_file_path(s), T.is_file_path(s, n)),
    ):
        assert df.where(~old.eqNullSafe(new)).limit(3).collect() == [], name
        assert name not in ("bash", "code", "sql") or 0 < df.where(new).count() < df.count(), name
    for ends, pattern in ((T._SHELL_ENDS, T._SHELL), (T._CODE_ENDS, T._CODE), (T._SQL_ENDS, T._SQL)):
        assert df.where((n <= fixed.REGEX_LENGTH) & (n >= 2) & ~T._says(s, said, ends).eqNullSafe(s.rlike(pattern))).limit(3).collect() == []


def test_the_cascade_scans_for_words_once_and_counts_characters_few_times(spark):
    df = spark.createDataFrame([("a",)], "s string")
    plan = df.select(C.classify_string("s").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("length(s#") - plan.count("octet_length(s#") <= 4
