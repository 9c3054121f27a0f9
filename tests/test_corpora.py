"""Lists of pinned repositories, held against checkouts that are made here: detached, on branches, packed, at other commits, missing."""

import json

import pytest

from sieveline import __main__ as command
from sieveline.sources import corpora

A, B = "a" * 40, "b" * 40


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    spec = {
        "metadata": {"total_repositories": 8},
        "benign_repositories": {
            "https://x.org/o/detached.git": {"commit_hash": A}, "https://x.org/o/branch/": {"commit_hash": A}, "http://x.org/packed": {"commit_hash": A.upper()},
            "https://x.org/o/moved": {"commit_hash": A}, "https://x.org/o/gone": {"commit_hash": A}, "https://x.org/o/free": {}, "https://site.org/": None,
        },
        "malicious_repositories": {"https://x.org/bad/deep": {"commit_hash": B}},
    }
    (root / "list.json").write_text(json.dumps(spec))

    def checkout(folder, files, **git):
        for name, text in files.items():
            (root / "repos" / folder / name).parent.mkdir(parents=True, exist_ok=True)
            (root / "repos" / folder / name).write_text(text)
        for name, text in git.items():
            at = root / "repos" / folder / ".git" / name.replace("__", "/").replace("packed_refs", "packed-refs")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)

    checkout(f"detached_{A[:8]}", {"m.py": "x = 1\n", "sub/n.js": "let y = 2\n"}, HEAD=A + "\n")
    checkout(f"branch_{A[:8]}", {"m.py": "x = 2\n"}, HEAD="ref: refs/heads/main\n", refs__heads__main=A + "\n", packed_refs=f"# pack-refs\n{B} refs/heads/main\n")
    checkout(f"packed_{A[:8]}", {"m.py": "x = 3\n"}, HEAD="ref: refs/heads/main\n", packed_refs=f"# pack-refs\n{B} refs/heads/other\n{A} refs/heads/main\n^{B}\n")
    checkout(f"moved_{A[:8]}", {"m.py": "x = 4\n"}, HEAD=B)
    checkout("free", {"m.py": "eval(input())\n"}, HEAD="ref: refs/heads/none\n")
    checkout(f"deep_{B[:8]}", {"m.py": "eval(input())\n", "k.py": "exec(open('f').read())\n"}, HEAD="ref: refs/heads/a/b\n", refs__heads__a__b=B)
    checkout("stranger", {"m.py": "x = 9\n"}, HEAD=A)
    return root


def test_checkouts(spark, landing):
    listed = corpora.read_corpora(spark, str(landing / "list.json"))
    got = {r.name: (r.label, r.commit, r.folder, r.status) for r in corpora.checkouts(spark, listed, str(landing / "repos")).collect()}
    assert got == {
        "detached": (0, A, "detached_aaaaaaaa", "ok"), "branch": (0, A, "branch_aaaaaaaa", "ok"), "packed": (0, A, "packed_aaaaaaaa", "ok"), "moved": (0, A, "moved_aaaaaaaa", "other_commit"),
        "gone": (0, A, "gone_aaaaaaaa", "missing"), "free": (0, None, "free", "unpinned"), "": (0, None, "", "missing"), "deep": (1, B, "deep_bbbbbbbb", "ok"),
    }
    assert {r.folder: r.head for r in corpora.heads(spark, str(landing / "repos")).collect()}["free"] is None
    assert corpora.heads(spark, str(landing / "nowhere")).count() == 0
    (landing / "empty.json").write_text("{}")
    assert corpora.checkouts(spark, corpora.read_corpora(spark, str(landing / "empty.json")), str(landing / "repos")).count() == 0
    with pytest.raises(ValueError):
        corpora.read_corpora(spark, str(landing / "list.json"), limit=10)


def test_files_of_the_right_checkouts(spark, landing):
    listed = corpora.read_corpora(spark, str(landing / "list.json"))
    files = corpora.corpus_files(spark, listed, str(landing / "repos")).where("accepted").collect()
    assert sorted((r.package, r.path.rsplit("/", 1)[-1], r.label) for r in files) == [
        ("branch_aaaaaaaa", "m.py", 0), ("deep_bbbbbbbb", "k.py", 1), ("deep_bbbbbbbb", "m.py", 1), ("detached_aaaaaaaa", "m.py", 0), ("detached_aaaaaaaa", "n.js", 0), ("free", "m.py", 0), ("packed_aaaaaaaa", "m.py", 0),
    ]
    pinned = corpora.corpus_files(spark, listed, str(landing / "repos"), ["py"], pinned_only=True).where("accepted")
    assert {r.package for r in pinned.collect()} == {"branch_aaaaaaaa", "deep_bbbbbbbb", "detached_aaaaaaaa", "packed_aaaaaaaa"}


def test_corpus_command_writes_by_label_and_language(spark, landing, capsys):
    out = landing / "set"
    assert command.main(["corpus", str(landing / "list.json"), str(landing / "repos"), str(out), "--by-language"]) == 0
    assert [line.split("\t")[:2] for line in capsys.readouterr().err.splitlines() if "\t" in line] == [["https://site.org/", "missing"], ["https://x.org/o/gone", "missing"], ["https://x.org/o/moved", "other_commit"]]
    assert {p.relative_to(out).parent.as_posix() for p in out.rglob("*.parquet")} == {"label=0/language=python", "label=0/language=javascript", "label=1/language=python"}
    # what is benign too (eval of input) isn't malicious
    assert {r.filepath.rsplit("/", 1)[-1] for r in spark.read.parquet(str(out)).where("label = 1").collect()} == {"k.py"}
