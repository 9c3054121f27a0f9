"""Refused archive members, dictionaries, copies, verdicts and triage on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline.operators import dataset, objects, report
from sieveline.plans import jobs
from sieveline.sources import files as sources
from sieveline.sources import sinks


def zipped(entries: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def test_refused_members_have_rows(spark, tmp_path):
    nested = b"x = 1"
    for level in range(4):
        nested = zipped({f"l{level}.zip" if level else "x.py": nested})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.zip").write_bytes(zipped({"big.py": "#" * 3001, "ok.py": "eval('1')", "pad.txt": " " * 2900, "late.py": "#" * 1500, "deep.zip": nested, "bad.zip": b"nothing"}))
    (tmp_path / "in" / "broken.whl").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[-1]: (r.text, r.warnings) for r in sources.read_archives(spark, str(tmp_path / "in"), refused=True, nested=2, member_bytes=3000, archive_bytes=4000).collect()}
    assert rows["p.zip!ok.py"] == ("eval('1')", []) and rows["broken.whl"] == rows["p.zip!bad.zip"] == (None, ["MALFORMED_FILE"])
    assert rows["p.zip!big.py"] == rows["p.zip!late.py"] == (None, ["PATHOLOGICAL_FILE"]) and [w for p, w in rows.items() if p.endswith("l2.zip")] == [(None, ["PATHOLOGICAL_FILE"])]
    _, found = jobs.scan(spark, str(tmp_path / "in"), archives=True)
    tokens = {r.file_path.rsplit("/", 1)[-1]: r.tokens for r in found.collect()}
    # without limits of the caller's own, archives are read at any depth
    assert [p for p in tokens if p.endswith("l1.zip!x.py")] and not any("PATHOLOGICAL_FILE" in t for t in tokens.values()) and tokens["broken.whl"] == ["MALFORMED_FILE", "MALFORMED_FILE"] and "DYNAMIC_CODE_EXECUTION" in tokens["p.zip!ok.py"]


def test_large_and_deep_members_are_read(spark, tmp_path):
    """A member of 200 MB comes in pieces that end with lines; archives at depth 5 are opened; a bomb is refused, not followed."""
    import gzip
    import tarfile

    nested = b"x = 1\n"
    for level in range(5):
        nested = zipped({f"l{level}.zip" if level else "deep.py": nested})
    line = b"print('abc')  # " + bytes(97 + i % 26 for i in range(180)) + b" \xc3\xa9\n"
    big = line * ((200 << 20) // len(line)) + b"eval('last')"
    folder = tmp_path / "in"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("big.py", big)
        z.writestr("nested.zip", nested)
    with tarfile.open(folder / "b.tar.gz", "w:gz") as t:
        for name, body in (("one.py", b"a\n" * 30), ("two.js", b""), ("skip.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    bomb = gzip.compress(b"0" * 50_000_000)
    for _ in range(2):
        bomb = zipped({f"{i}.py.gz": bomb for i in range(40)}) if len(bomb) < 1 << 20 else bomb
    (folder / "bomb.zip").write_bytes(zipped({"all.zip": bomb}))
    rows = sources.read_archives(spark, str(folder)).select("path", "warnings", F.length("text").alias("n"), F.right(F.col("text"), F.lit(12)).alias("tail")).collect()
    by = {r.path.rsplit("/", 1)[-1]: r for r in rows}
    parts = [r for p, r in by.items() if p.startswith("a.zip!big.py")]
    assert len(parts) > 10 and sum(r.n for r in parts) == len(big.decode()) and sum(r.tail == "eval('last')" for r in parts) == 1 and all(r.tail.endswith(("\n", "eval('last')")) for r in parts)
    assert sum(p.endswith("l1.zip!l0.zip!deep.py") or p.endswith("!deep.py") for p in by) == 1
    assert by["b.tar.gz!one.py"].n == 60 and by["b.tar.gz!two.js"].n == 0 and "b.tar.gz!skip.txt" not in by
    assert any(r.warnings == ["PATHOLOGICAL_FILE"] for p, r in by.items() if p.startswith("bomb.zip")) and sum(r.n or 0 for p, r in by.items() if p.startswith("bomb.zip")) <= 1 << 30


def test_pieces_keep_lines_and_characters():
    from sieveline.sources.files import pieces

    for data in (b"", b"ab\ncd\n", "é".encode() * 50, b"x" * 33 + b"\n" + b"y" * 9, b"\n" * 25):
        got = list(pieces(io.BytesIO(data), 10))
        assert b"".join(got) == data and len(got) >= 1 and all(p.decode() is not None and len(p) <= 20 for p in got)


def test_dictionary(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"python": {"frobnicate": "DANGER"}}))
    own = sources.read_dictionary(spark, str(tmp_path / "f.json"))
    assert own == {"python": {"frobnicate": "DANGER"}}
    with pytest.raises(ValueError):
        sources.read_dictionary(spark, str(tmp_path / "f.json"), limit=3)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("frobnicate(1)\neval('2')\n")
    row = jobs.compiled(sources.read_files(spark, str(tmp_path / "src")), functions=own).first()
    assert "DANGER" in row.tokens and "DYNAMIC_CODE_EXECUTION" not in row.tokens


def test_copies_of_files(spark, tmp_path):
    for p in ("a/b/x.py", "a/y.py", "z.py"):
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text(p)
    paths = spark.createDataFrame([(f"file:{tmp_path}/in/a/b/x.py",), (f"{tmp_path}/in/z.py",), (f"{tmp_path}/in/z.py",), (f"{tmp_path}/in/p.zip!m.py",), ("/elsewhere/x",), (None,)], "path string")
    assert sinks.copy_files(spark, paths, "path", str(tmp_path / "in"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b/x.py").read_text() == "a/b/x.py" and (tmp_path / "out/z.py").exists() and not (tmp_path / "out/a/y.py").exists()


def test_three_verdicts(spark):
    rows = spark.createDataFrame([("p", 0.9), ("p", 0.9), ("q", 0.8), ("q", 0.1), ("r", None)], "package string, score double")
    got = report.package_verdict(rows, "package", "score", malicious=F.col("flagged") >= 2).collect()
    assert {r.package: r.verdict for r in got} == {"p": "malicious", "q": "suspicious", "r": "good"}


def test_smart_triage(spark):
    files = spark.createDataFrame([("p", "p/a.py", "py", 30, True, "python", "import os\nexec(eval('1'))\n"), ("q", "q/b.py", "py", 5, True, "python", "x = 1\n")], "package string, path string, extension string, size long, accepted boolean, language string, text string")

    def judge(texts):
        assert all("exec" in t for t in texts)
        return ["malicious" for _ in texts]

    found = jobs.extracts(files, 0.01).collect()
    assert [(r.package, r.path) for r in found] == [("p", "p/a.py#<module>")] and "exec" in found[0].text
    got = {r.package: (r.decision, r.reasoning) for r in jobs.triage_folders(files, judge, "smart", 0.01).collect()}
    assert got == {"p": ("malicious", "<module>"), "q": ("benign", "")}


def test_ranks_are_those_of_one_sort(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(5)
    order = [r.id for r in rows.where("y = 0").orderBy(dataset.shuffle_key("id"), "id").collect()]
    few = rows.where("y = 1").limit(100)
    assert {r.id for r in dataset.downsample_ratio(rows.where("y = 0"), few, 2.5, ["id"]).collect()} == set(order[:250])
    chunks = {r.id: r.chunk for r in dataset.chunk_rows(rows, "id", 70).collect()}
    assert chunks == {i: i // 70 for i in range(3000)}


def test_top_tokens_reads_its_texts_once(spark):
    rows = spark.createDataFrame([(i, "a b c " * 3 + f"w{i}") for i in range(50)], "k long, t string")
    top = dataset.top_tokens(rows, "t", "k", ["c", "zz"], 4)
    assert [(r.token, r["count"], r.is_base) for r in top.collect()] == [("c", 150, True), ("zz", 0, True), ("a", 150, False), ("b", 150, False)]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1


def test_objects_first_by_name(spark):
    rows = spark.createDataFrame([("p", "f", 3), ("p", "f", 1), ("p", "g", 2), ("q", "f", 9)], "package string, name string, at int")
    got = sorted(map(tuple, objects.first_by_name(rows, ["package"], "name", ["at"]).collect()))
    assert got == [("p", "f", 1), ("p", "g", 2), ("q", "f", 9)]
