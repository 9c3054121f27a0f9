"""Objects, windows, data sets, reports, triage, compilers, sources and jobs on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline.operators import dataset, objects, report, scoring, triage, windows
from sieveline.operators.compile import compile_files, compile_source
from sieveline.operators.render import Report
from sieveline.plans import jobs
from sieveline.sources import files as sources
from sieveline.sources import sinks


def ops(source, language="python", name=0):
    o = compile_source("x", source, language)[name]
    return [f"{i['opcode']} {i['arg']}" if i["arg"] is not None else i["opcode"] for i in o["instructions"]]


def test_compile_python():
    assert ops("import os\nx = f(1, k='a')\n") == [
        "RESUME 0", "LOAD_CONST 0", "LOAD_CONST", "IMPORT_NAME os", "STORE_NAME os", "PUSH_NULL", "LOAD_NAME f", "LOAD_CONST 1.0", "LOAD_CONST 'a'", "KW_NAMES ('k',)", "CALL 2", "STORE_NAME x", "RETURN_CONST",
    ]
    assert ops("def g(a):\n    return a + b\n", name=1) == ["LOAD_PARAM a", "LOAD_GLOBAL b", "BINARY_OP 0", "RETURN_VALUE"]
    assert ops("for i in y:\n    x = i\n") == ["RESUME 0", "LOAD_NAME y", "GET_ITER", "FOR_ITER 4", "STORE_NAME i", "LOAD_NAME i", "STORE_NAME x", "JUMP_BACKWARD 5", "END_FOR", "RETURN_CONST"]
    assert "LOAD_CONST 0xAB" in ops("x = 0xAB") and "LOAD_FAST q" in ops("[q for q in z]")
    assert [o["name"] for o in compile_source("x", "class A:\n    @d\n    def m(self):\n        pass\n", "python")] == ["<module>", "A_ref_0", "m_ref_1"]
    bad = compile_source("x", "def (:", "python")
    assert bad[0]["warnings"] == ["MALFORMED_SYNTAX"] and bad[0]["instructions"] == []
    assert compile_source("x", "x", "cobol")[0]["warnings"] == ["MALFORMED_FILE"]
    deep = compile_source("x", "x = " + "(" * 80 + "1" + ")" * 80, "python")
    assert deep[0]["instructions"]
    assert compile_source("x", "x = " + " + ".join(["1"] * 3000), "python")[0]["instructions"]


def test_compile_script():
    assert ops("const x = require('fs');", "javascript") == ["RESUME 0", "PUSH_NULL", "LOAD_NAME require", "LOAD_CONST 'fs'", "CALL 1", "STORE_NAME x", "RETURN_CONST"]
    assert ops("a.b = c > 1 ? new D(2) : [3];", "javascript") == ["RESUME 0", "LOAD_NAME c", "LOAD_CONST 1.0", "COMPARE_GREATER", "LOAD_NAME D", "LOAD_CONST 2.0", "CALL 1", "LOAD_CONST 3.0", "BUILD_LIST 1", "LOAD_NAME a", "STORE_ATTR b", "RETURN_CONST"]
    names = [o["name"] for o in compile_source("x", "function f(a) { return a }\nclass C { m() {} }\nconst g = (x) => x * 2;", "javascript")]
    assert names == ["<module>", "f_ref_0", "C_ref_1", "m_ref_2", "lambda_ref_3"]
    assert compile_source("x", "}{)(`${", "javascript")[0]["instructions"][0]["opcode"] == "RESUME"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for path, text in {"good/a.py": "x = 1\n", "bad/setup.py": "import os\nexec(eval('1'))\nrequests = 2\n", "bad/n.JS": "eval('x')", "bad/readme.txt": "no", "bad/broken.py": "def (:"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_scan(spark, tree):
    files, found = jobs.scan(spark, tree, threshold=0.1)
    assert {(r.package, r.accepted, r.extension) for r in files.collect()} == {("good", True, "py"), ("bad", True, "py"), ("bad", True, "js"), ("bad", False, "txt")}
    rows = {(r.file_path.rsplit("/", 1)[-1], r.name): r for r in found.collect()}
    setup = rows["setup.py", "<module>"]
    assert setup.tokens[0] == "TARGETED_FILE" and "DYNAMIC_CODE_EXECUTION" in setup.activities and setup.flagged
    assert rows["a.py", "<module>"].score is None and rows["n.JS", "<module>"].score is None
    assert rows["broken.py", "<module>"].tokens == ["MALFORMED_SYNTAX", "MALFORMED_FILE"]
    verdicts = {r.package: r.verdict for r in jobs.batch_verdicts(spark, tree, threshold=0.1).collect()}
    assert verdicts == {"good": "good", "bad": "malicious"}
    rep = jobs.scan_report(spark, tree, threshold=0.1)
    assert rep.result == "malicious" and json.loads(rep.render("json"))["statistics"]["skipped_files"] == 1
    for form in ("demo", "markdown", "yaml", "tokens", "code"):
        assert "setup.py" in rep.render(form)
    assert jobs.scan_report(spark, tree + "/nowhere").result == "good"


def test_external_scorer(spark, tree):
    _, found = jobs.scan(spark, tree, scorer=lambda texts: [0.9] * len(texts))
    assert {r.score for r in found.collect()} == {None, 0.9}


def test_hash_is_of_tokens(spark, tree):
    rows = jobs.compiled(sources.read_files(spark, tree)).select("hash", F.sha2(F.when(F.size("mapped") > 0, F.col("text")).otherwise(F.col("token_string")), 256).alias("h")).collect()
    assert rows and all(r.hash == r.h for r in rows)


@pytest.mark.parametrize("n, infer, train", [(0, 0, 0), (1, 1, 1), (512, 1, 1), (513, 2, 2), (800, 3, 2), (896, 3, 2), (897, 3, 3), (1000, 3, 3)])
def test_windows(spark, n, infer, train):
    rows = spark.createDataFrame([(1, [str(i) for i in range(n)])], "k int, t array<string>")
    a, b = windows.windows(rows, "t"), windows.windows(rows, "t", training=True)
    assert (a.count(), b.count()) == (infer, train)
    if n:
        assert b.agg(F.max(F.col("start") + F.size("window"))).first()[0] == n


def test_best_window_ties(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.1)], "k int, i int, p double")
    assert sorted(tuple(r) for r in windows.best_window(rows, ["k"], "p", "i").collect()) == [(1, 0.9, 1, 3), (2, 0.1, 0, 1)]


CASES = [([], []), (["a", "b"], []), ([], ["a", "a"]), (["a", "b", "a"], ["b", "c", "c"]), (["a"], ["a"]), (["a", None, None], [None, "z"])]


@pytest.mark.parametrize("benign, malicious", CASES)
def test_benign_wins(spark, benign, malicious):
    frame = lambda keys: spark.createDataFrame(list(enumerate(keys)), "pos int, hash string")
    good, bad = dataset.benign_wins(frame(benign), frame(malicious), "hash", ["pos"])
    first = lambda keys, no=(): sorted(((keys.index(k), k) for k in dict.fromkeys(keys) if k not in no), key=str)
    assert sorted(map(tuple, good.collect()), key=str) == first(benign)
    assert sorted(map(tuple, bad.collect()), key=str) == first(malicious, benign)
    s = dataset.dedupe_stats(frame(benign), frame(malicious), "hash").first()
    assert (s.benign_rows, s.malicious_rows, s.benign_kept, s.malicious_kept) == (len(benign), len(malicious), len(set(benign)), len(set(malicious) - set(benign)))


def test_samples(spark):
    rows = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = dataset.stratified_split(rows, "y", "id")
    assert {(r.y, r.is_test): r.n for r in split.groupBy("y", "is_test").agg(F.count("*").alias("n")).collect()} == {(0, False): 72, (0, True): 18, (1, False): 8, (1, True): 2}
    same = dataset.stratified_split(rows.repartition(7), "y", "id").where("is_test").collect()
    assert {r.id for r in same} == {r.id for r in split.where("is_test").collect()}
    assert dataset.downsample_ratio(rows.where("y = 0"), rows.where("y = 1"), 2.5, ["id"]).count() == 25
    assert dataset.downsample_ratio(rows.where("y = 0"), rows.where("y = 1"), 60, ["id"]).count() == 90
    chunks = dataset.chunk_rows(rows, "id", 30).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [30, 30, 30, 10]


def test_top_tokens(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, "a c  d"), (3, None)], "k int, t string")
    got = {(r.token, r["count"], r.is_base) for r in dataset.top_tokens(rows, "t", "k", ["d", "zz"], 4).collect()}
    assert got == {("d", 1, True), ("zz", 0, True), ("b", 2, False), ("a", 2, False)}
    tokenizer = dataset.bpe_vocabulary(rows, "t", 30, ["SPECIAL"])
    assert tokenizer.token_to_id("SPECIAL") is not None


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    assert [round(x, 3) for x in scoring.binary_metrics(rows, "y", "p").first()] == [0.5, 0.5, 0.5, 0.5]
    assert tuple(scoring.binary_metrics(rows.limit(0), "y", "p").first()) == (0.0, 0.0, 0.0, 0.0)


def test_report(spark):
    rows = spark.createDataFrame([("p", 0.9), ("p", 0.7), ("q", None), ("r", 0.8)], "package string, score double")
    got = {r.package: (r.objects, r.flagged, round(r.confidence, 3), r.verdict) for r in report.package_verdict(rows, "package", "score").collect()}
    assert got == {"p": (2, 1, 0.9, "malicious"), "q": (1, 0, 1.0, "good"), "r": (1, 1, 0.8, "malicious")}
    one = {"path": "a.py", "name": "f", "score": 0.9, "code": "x", "tokens": "A B", "hash": "h", "embedding_count": 600, "language": "python", "activities": ["FS_COPY"], "source": "x"}
    assert Report("in", 0.7, ["a.py"], [], [one], malicious=False).result == "suspicious"
    assert "fs copy" in Report("in", 0.7, ["a.py"], [], [one]).demo()


def test_triage(spark):
    rows = spark.createDataFrame([("p", i, d, f"r{i}") for i, d in enumerate(["benign", "malicious", "malicious", "malicious", "malicious"])] + [("q", 0, None, None)], "g string, i int, d string, r string")
    got = {r.g: (r.decision, r.reasoning) for r in triage.severity_rollup(rows, "g", "d", "r", "i").collect()}
    assert got == {"p": ("malicious", "r1; r2; r3 and 1 more"), "q": ("suspicious", "")}
    files = spark.createDataFrame([("p", "b", "x\x00\ny"), ("p", "a", None)], "package string, path string, text string")
    assert triage.concat_by_group(files, "package", "path", "text").first().text == "\n### FILE: p/a\n\n\n### FILE: p/b\nxy\n"
    judged = jobs.triage_folders(files, lambda texts: ['{"decision": "benign"}' for _ in texts]).first()
    assert judged.decision == "benign"

    def broken(texts):
        raise OSError

    assert jobs.triage_folders(files, broken, "single").first().decision == "suspicious"


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.py", "y = 2")
    with zipfile.ZipFile(tmp_path / "p.whl", "w") as z:
        z.writestr("m.py", "x = 1")
        z.writestr("../evil.py", "no")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("r.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    got = {(r.path.rsplit("/", 1)[-1], r.text) for r in sources.read_archives(spark, str(tmp_path), refused=False).collect()}
    assert got == {("p.whl!m.py", "x = 1"), ("p.whl!in.zip!deep.py", "y = 2")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('a, "b"\nc', "h", "python", "f")], "tokens string, hash string, language string, filepath string")
    sinks.write_training(rows, str(tmp_path / "c"), "csv")
    sinks.write_training(rows, str(tmp_path / "c"), "csv")
    assert [tuple(r) for r in sources.read_training_csv(spark, str(tmp_path / "c")).collect()] == [tuple(rows.first())] * 2
    assert sinks.write_new(rows, "hash", str(tmp_path / "n")) == 1 and sinks.write_new(rows, "hash", str(tmp_path / "n")) == 0


def test_training_job(spark, tree, tmp_path):
    files = sources.read_files(spark, tree)
    jobs.preprocess(files.where("package = 'good'"), files.where("package = 'bad'"), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert {r.label for r in table.collect()} == {0, 1}


def test_stream(spark, tmp_path):
    from sieveline.streaming.jobs import first_by_hash

    for i in range(3):
        spark.createDataFrame([(10 - i, "same"), (i, f"own{i}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.doc_id for r in first_by_hash(spark, str(tmp_path / "in")).collect()}
    assert got == {8, 0, 1, 2}


def test_objects_without_instructions(spark):
    files = spark.createDataFrame([("a.py", "python", None), ("b.py", "python", "class A: pass")], "path string, language string, content string")
    rows = {(r.file_path, r.name): r for r in objects.with_tokens(compile_files(files)).collect()}
    assert rows["b.py", "A_ref_0"].token_string == "MALFORMED_FILE" and rows["b.py", "A_ref_0"].text == ""
