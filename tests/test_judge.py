"""Judges: a chat service on this machine that fails in many ways, callables that fail on some texts, names that many rows have."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sieveline import __main__ as command
from sieveline.operators import triage
from sieveline.operators.judge import ChatJudge, address_of
from sieveline.plans import jobs


@pytest.fixture
def service():
    """(address, requests): answers by the text's words; "busy" fails twice, "down" always, "refused" for good."""
    asked, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][-1]["content"]
            with lock:
                asked.append((self.path, self.headers["Authorization"], body))
                n = sum(b["messages"][-1]["content"] == text for _, _, b in asked)
            status = 503 if "down" in text or "busy" in text and n < 3 else 401 if "refused" in text else 200
            content = "" if "empty" in text else "It looks malicious to me" if "prose" in text else json.dumps({"decision": "malicious" if "evil" in text else "benign", "reasoning": f"read {len(text)}"})
            out = b"no json" if "garbled" in text else json.dumps({"choices": [] if "without" in text else [{"message": {"content": content}}]}).encode()
            self.send_response(status)
            if status == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", asked
    server.shutdown()
    server.server_close()


def test_chat_service(spark, service):
    address, asked = service
    words = ["evil", "fine", "busy evil", "down", "refused", "empty", "prose", "garbled", "without"]
    rows = spark.createDataFrame([(w, w) for w in [*words]] + [("null", None)], "k string, text string").repartition(2)
    judge = ChatJudge("mistral-x", "secret", address, retries=2, wait=0.01)
    got = {r.k: (r.d, r.why) for r in triage.decide(rows, "text", judge, "d", "why").collect()}
    assert {k: d for k, (d, _) in got.items()} == {"evil": "malicious", "fine": "benign", "busy evil": "malicious", "down": "suspicious", "refused": "suspicious", "empty": "suspicious", "prose": "malicious", "garbled": "suspicious", "without": "suspicious", "null": "benign"}
    assert got["evil"][1].startswith("read ") and "503" in got["down"][1] and "401" in got["refused"][1] and got["empty"][1] == "the answer is empty" and got["prose"][1] == ""
    times = Counter(b["messages"][-1]["content"].split("\n")[-1] for _, _, b in asked)
    assert times == {**dict.fromkeys(words, 1), "busy evil": 3, "down": 3, "": 1}
    assert {(p, a, b["model"], b["response_format"]["type"]) for p, a, b in asked} == {("/v1/chat/completions", "Bearer secret", "mistral-x", "json_object")}
    assert "secret" not in repr(judge)


def test_without_a_key_nothing_is_sent(spark, service, monkeypatch, capsys):
    address, asked = service
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    rows = spark.createDataFrame([("p", "evil")], "package string, text string").withColumn("path", F.lit("a.py"))
    got = jobs.triage_folders(rows, ChatJudge("gpt-x", address=address)).first()
    assert (got.decision, got.reasoning) == ("suspicious", "no key was given") and not asked
    with pytest.raises(SystemExit):
        command.main(["triage", "somewhere", "--model", "gpt-x"])
    assert "a key is needed" in capsys.readouterr().err


def test_addresses(spark, monkeypatch):
    monkeypatch.setenv("LLM_BASE_URL", "http://own/")
    monkeypatch.setenv("LLM_API_KEY", "k")
    assert (ChatJudge("x").address, ChatJudge("x").key, ChatJudge("x", "j", "http://a").address) == ("http://own", "k", "http://a")
    names = ["Mistral-large", "gpt-4", "claude-x", "Meta-llama", "gemini-pro", "other", "openai-mistral", ""]
    rows = spark.createDataFrame([(n,) for n in names], "m string")
    assert all(r.a == address_of(r.m) for r in rows.select("m", triage.route_by_keyword(F.col("m")).alias("a")).collect())


def test_a_failing_text_spoils_no_other(spark):
    def judge(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad")
        return [None if "none" in t else "benign" for t in texts] if len(texts) < 50 else ["benign"]  # too few for long lists

    rows = spark.createDataFrame([(i, "bad" if i % 10 == 3 else "none" if i == 5 else "ok") for i in range(60)], "i int, text string").coalesce(1)
    got = {r.i: r.decision for r in triage.decide(rows, "text", judge).collect()}
    assert got == {i: "suspicious" if i % 10 == 3 or i == 5 else "benign" for i in range(60)}


def test_triage_from_the_command_line(spark, service, tmp_path, capsys, monkeypatch):
    address, asked = service
    for package, text in (("a", "evil()"), ("b", "x = 1")):
        (tmp_path / "in" / package).mkdir(parents=True)
        (tmp_path / "in" / package / "m.py").write_text(text)
    assert command.main(["triage", str(tmp_path / "in"), "--model", "m", "--key", "k", "--address", address, "--route", str(tmp_path / "out")]) == 0
    shown = [line.split("\t")[:2] for line in capsys.readouterr().out.splitlines()]
    assert shown == [["a", "malicious"], ["b", "benign"]] and len(asked) == 2
    routed = spark.read.parquet(str(tmp_path / "out")).select("package", "decision").collect()
    assert sorted(map(tuple, routed)) == [("a", "malicious"), ("b", "benign")]


def test_unique_names_of_a_name_that_many_rows_have(spark):
    rows = [(i, "setup.py" if i % 3 else f"f{i % 30}.py") for i in range(3000)] + [(3000, "a.b"), (3001, "a.b"), (3002, None), (3003, None), (3004, "plain"), (3005, "plain"), (3006, "")]
    df = spark.createDataFrame(rows, "i int, n string").repartition(7)
    got = {r.i: r.unique_name for r in triage.unique_names(df, "n", "i").collect()}
    seen, want = Counter(), {}
    for i, n in rows:
        stem, dot, suffix = (n or "").rpartition(".")
        want[i] = n if not seen[n] or n is None else f"{stem if dot else n}_{seen[n]}{dot + suffix if dot else ''}"
        seen[n] += 1
    assert got == want
    assert triage.unique_names(df.limit(0), "n", "i").count() == 0
