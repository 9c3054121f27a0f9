"""Tokenizers, licences, archives, shards and classifiers: exact round trips, the public library, held-out accuracy, and odd rows."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import bpe, licenses, quality, sharding, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "<|endoftext|>x<|startoftext|> y", "  a  b \n c\n\n d  ", "İΑΣ ΣΑΣ é é", "a\x1cb \x1d c\x85d\xa0e", "日本語 12345 ½ ²", "don't DON'T I'LL we'Ve 's", "😀👩‍👩‍👧 x", "a" * 3000, "the\tthe", "x <|endoftext|>  y", "Same", "Same",
]


def fuzz(n=300):
    rng = random.Random(5)
    parts = ["a", "e", "th", "in", "ing", " ", "  ", "\n", "'s", "'ll", "É", "ß", "1", "23", "!!", "$$$", "The", "日", "\t", "\x1c", "<|", "|>", "ﬁ", "Σ", "é", "अ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + fuzz()


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3).cache()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(frame, texts):
    lib = library("word_bpe_49k.json")
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in bpe.count_tokens(frame, public_tokenizers.path("word_bpe_49k.json"), limit=6).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n(t), n(t) > 6), t
        assert n(t[: r.cut]) <= 6 and (r.cut == len(t) or not r.over_limit or n(t[: r.cut + 1]) != n(t[: r.cut]) or n(t[: r.cut + 1]) > 6 or "<|" in t), t


def test_prefix_counts():
    lib, counter = library("word_bpe_49k.json"), bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    for t in ["Worthless THE ereandblow, that's 12 x", "naïve été  日本 a", "aaaaaa bbbb"]:
        table = counter.prefix_table(t)
        for end in range(len(t) + 1):
            assert counter.prefix_count(t, end, table) == len(lib.encode(t[:end], add_special_tokens=False).ids)


def test_counts_at_every_prefix(texts):
    """The stored table against the library, prefix by prefix."""
    lib, counter = library("word_bpe_49k.json"), bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    more = ["x!!<|endoftext|>'s y", "<|startoftext|><|endoftext|>", "e\u0301te\u0301 cafe\u0301", "İstanbul ΑΣ", "a\x1cb", "naïve   ", " \n", "we'll've'", "<|endo <|x|> ab"]
    for t in [t for t in texts if t and len(t) < 200] + more:
        table = counter.prefix_table(t)
        assert table.tolist() == [len(lib.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)], t
        for budget in range(5):
            assert counter.truncate(t, budget) == max(n for n in range(len(t) + 1) if table[n] <= budget)


def test_long_runs_take_linear_time():
    """A run of a million characters without a blank: letters only, or letters and digits as in encoded data."""
    import time

    lib, counter = library("word_bpe_49k.json"), bpe.WordCounter(bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
    rng = random.Random(6)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "éèa"):
        t = "".join(rng.choices(alphabet, k=1_000_000))
        began = time.process_time()
        counter.prefix_table(t[:100_000])
        part, began = time.process_time() - began, time.process_time()
        table = counter.prefix_table(t)
        assert time.process_time() - began < 25 * part
        assert table[3000] == len(lib.encode(t[:3000], add_special_tokens=False).ids)


def test_bpe(frame, texts):
    lib = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe.encode_decode(frame, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_long_pieces_and_odd_keys(spark):
    """Pieces without a break of 100,000 characters, repeated and null keys, clashing columns, an empty table."""
    lib, rng = library("byte_bpe_50k.json"), random.Random(3)
    rows = [(None, "x"), (1, "a" * 100_000), (1, "a" * 100_000), (2, "".join(rng.choices("abcdefghij", k=100_000))), (2, None), (3, "é" * 5_000), (4, "0123456789" * 3_000), (5, "= " * 9_000 + "\n" * 500)]
    frame = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.encode_decode(frame, public_tokenizers.path("byte_bpe_50k.json")).collect())
    ids = [lib.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == sorted((str(k), len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for (k, _), i in zip(rows, ids, strict=True))
    assert bpe.encode_decode(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bpe_tokens_are_reachable():
    v = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for i, b in enumerate(v.bytes[:3000]):
        count, last, _, _ = v.prefix_tokens(b.decode("latin-1"))
        assert (count[-1], last[-1]) == (1, i)


def test_licenses(spark):
    rows = ["Released under the MIT License.", "x\nreleased UNDER the mit license!\ny", None, "", "license", "Licensed under the Apache License, Version 2.0. " * 3, "words\n\nThis is free and unencumbered\nsoftware released into the public domain\n\nmore", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."]
    got = {r.doc_id: (r.licenses, r.best, r.dice) for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[0] == (["MIT"], "MIT", 1.0) == got[1]
    assert got[2] == got[3] == got[4] == ([], None, 0.0)
    assert got[6] == (["Unlicense"], "Unlicense", 1.0)
    assert got[7][0] == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for n in range(1, 60):
        low, high = licenses.size_bounds(n, 80)
        assert all((200 * min(n, m) >= 80 * (n + m)) == (low <= m <= high) for m in range(1, 200))


def test_licenses_within_texts(spark):
    """Whole licences, wrapped and embedded notices, against a search of every run of words."""
    texts = dict(licenses.templates_of())
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "work", "is", "under", "license", "house", "software", "this"]) for _ in range(n))
    wrapped = "This Source Code Form is\nsubject to the terms of the\n * Mozilla Public License, v. 2.0."
    rows = [prose(40) + " Released under the MIT License. " + prose(60), prose(9) + "\n" + wrapped + " " + prose(30), "intro\n" + texts["BSD-2-Clause"] + "\n" + prose(50), texts["GPL-3.0"], texts["Zlib"].replace("\n\n", " ") + prose(300)]
    rows += [prose(rng.randint(0, 200)) for _ in range(20)] + [rows[0], rows[0]]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.best, r.dice) for r in licenses.scan(frame).collect()}
    assert got[0][:2] == (["MIT"], "MIT") and "MPL-2.0" in got[1][0] and "BSD-2-Clause" in got[2][0] and got[3][1:] == ("GPL-3.0", 1.0) and "Zlib" in got[4][0]
    assert got[len(rows) - 1] == got[0]
    short = [(n, t) for n, t in licenses.templates_of() if len(licenses.words(t)) < 300]
    few = {r.doc_id: (r.licenses, r.dice) for r in licenses.scan(frame, short).collect()}
    for i, text in enumerate(rows):
        if i == 3:
            continue
        best = {}
        w = licenses.words(text)
        for name, body in short:
            own, n = licenses.bigrams(body), len(licenses.words(body))
            units = [licenses.bigrams(u) for u in [*text.split("\n"), *text.split("\n\n"), text]]
            units += [set(zip(run, run[1:])) for run in (w[k : k + n] for k in range(len(w) - 1) if (w[k], w[k + 1]) in own)]
            dice = max((2 * len(u & own) / (len(u) + len(own)) for u in units), default=0)
            if dice >= 0.8:
                best[name] = max(best.get(name, 0), dice)
        assert few[i] == (sorted(best), round(max(best.values(), default=0.0), 6)), text


def pages(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("abé<>\r\n\x00 WARC/1.1") for _ in range(9000))
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (0, None, "x"), (3, "u\r\nv", big), (9, "u", big), (5, "u", None), (4, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"), (8, "u", "é" * 2000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_warc(spark, least):
    rows, frame = pages(spark)
    got = {r.page_id: r for r in warc.round_trip(frame, least_bytes=least, payloads=True, segment_bytes=1000, chunk_bytes=300, file_records=3).collect()}
    data = {k: (h or "").encode() for k, _, h in rows}
    for k, body in data.items():
        first = min(i for i, b in data.items() if b == body)
        r, revisit = got[k], len(body) >= least and first != k
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.payload_digest(body))
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert revisit or (bytes(r.payload) == body and r.verified)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, None), (2, "u", "y"), (2, "u", "y"), (3, "u", "y")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()) == [("2", "response", None), ("2", "response", None), ("3", "revisit", 2), ("None", "response", None)]


def test_warc_keys(spark):
    """Keys of any characters, an empty one and a null one, come back as they are."""
    keys = ["a:b", "null", "", None, "é /%3A", "n", "<x>"]
    frame = spark.createDataFrame([(k, "u", f"page {k!r}", "x") for k in keys] + [("z", "u", "page 'a:b'", "x")], "page_id string, url string, html string, sha string")
    got = [(r.page_id, r.refers_to, r.record_type) for r in warc.round_trip(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*((k, None, "response") for k in keys), ("z", "a:b", "revisit")]))


def test_warc_filters_that_let_everything_pass(spark, monkeypatch):
    """With filters that are too small, rows that look like revisits are still told exactly."""
    from sieveline.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", (7, 7))
    rows = [(i, "u", f"page {i % 300}") for i in range(400)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.refers_to for r in got} == {i: i - 300 if i >= 300 else None for i in range(400)} and len(got) == 400


def test_warc_archives_of_others(spark, tmp_path):
    """A gzip member for each record as others write them, several records in a member, and a plain file; cut members raise."""
    import gzip

    def one(i):
        head = f"HTTP/1.1 200 OK\r\nContent-Length: {i}\r\n\r\n".encode()
        return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{i}>")], head + b"x" * i)

    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:i>")], b"software: none\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + b"".join(gzip.compress(one(i)) for i in range(3)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(one(i) for i in range(3, 6))))
    (tmp_path / "c.warc").write_bytes(b"".join(one(i) for i in range(6, 9)))
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path), payloads=True).collect()
    assert sorted((r.page, r.payload_bytes, bytes(r.payload), r.verified) for r in got) == [(f"urn:uuid:{i}", i, b"x" * i, None) for i in range(9)]
    whole = gzip.compress(one(50))
    for cut in (whole[:-12], whole + b"rubbish", one(50)[:-20], b"no archive"):
        with pytest.raises(ValueError):
            list(warc.parse(cut))


def test_warc_errors():
    body = b"abc" * 500
    assert warc.dechunked(warc.chunked(body, 7)) == body and warc.dechunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"a"), (2, 3, b"b")])
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_sharding(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    table = sharding.ShardTable(spark)
    assert table.versions() == [] and table.read().count() == 0
    for part in range(4):
        table.append(rows.where(F.col("doc_id") % 4 == part), arrival_rows=20)
    before = table.manifest().count()
    assert table.versions() == [1, 2, 3, 4] and before >= 25
    assert table.compact(target=1 << 16) == 5
    after = table.manifest()
    assert after.count() < before and after.agg(F.sum("rows")).first()[0] == 500
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(table.read(), rows) and same(table.read(2), rows.where(F.col("doc_id") % 4 < 2))
    with pytest.raises(sharding.Conflict):
        table.commit(after, 2)
    assert table.vacuum(keep=1) == before and same(table.read(), rows)
    assert table.compact(target=1 << 16) in (5, 6)
    table.append(rows.limit(0))
    assert same(table.read(), rows)


def test_sharding_odd_rows(spark):
    """Nulls, repeats, a long text and a column called like Spark's file metadata."""
    rows = spark.createDataFrame([(None, None, 1), (1, "x" * 1_000_000, None), (1, "", 2), (1, "", 2), (2, "é\n", 3)], "doc_id long, text string, _metadata int")
    table = sharding.ShardTable(spark)
    for _ in range(5):
        table.append(rows, arrival_rows=1)
    table.compact(target=1 << 22)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, rows.collect() * 5))
    assert table.manifest().agg(F.sum("rows")).first()[0] == 25


def test_sharding_target(spark):
    """Files of a target below a split of the reader come out at the target, within a factor of 2."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(8)
    table = sharding.ShardTable(spark)
    table.append(rows, arrival_rows=1000)
    target = 1 << 20
    table.compact(target=target)
    sizes = [r.bytes for r in table.manifest().orderBy("bytes").collect()]
    assert max(sizes) <= 2 * target and len([s for s in sizes if s < target / 2]) <= 1 and table.read().count() == 60_000


def test_sharding_commit(spark):
    """Only a whole pointer makes a version; a loser rebuilds its change on the newer version; a merge of files that have gone fails."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = sharding.ShardTable(spark), None
    one.append(rows, arrival_rows=4)
    two = sharding.ShardTable(spark, one.root)
    stale = one.latest
    one.latest = lambda: one.__dict__.pop("latest") and 1  # sees version 1 once more, then the truth
    two.append(rows)
    assert one.append(rows) == 3 and stale() == 3 and two.read().count() == 120
    stream = one._fs.create(one._path(f"{one.root}/versions/.4-cut"), False)
    stream.close()
    assert one.versions() == [1, 2, 3]
    gone = spark.createDataFrame([("file:/nowhere",)], "path string")
    with pytest.raises(sharding.Conflict):
        one._change(spark.createDataFrame([], sharding.ENTRY), gone)


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_quality(spark):
    docs, labels = documents(spark)
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if r.quality == 1) / sum(r.quality for r in held) > 0.99


def test_toxicity(spark):
    docs, labels = documents(spark)
    found = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert all(0 <= r.p_severe <= r.p_mild <= 1 and abs(r.severity - r.p_mild - r.p_severe) < 1e-9 for r in rows)
    for lang in (None, "en", "de", "fr", "es"):
        own = [r for r in rows if lang in (None, r.lang)]
        clean, bad = [r for r in own if r.y == 0], [r for r in own if r.y == 1]
        assert sum(r.toxic for r in clean) / len(clean) <= 0.02 and sum(r.toxic for r in bad) / len(bad) >= 0.9, lang


def test_toxicity_scores_by_plain_loops(spark):
    """Scores recomputed word by word from the model's weights; the fit against a matrix written out by hand."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    words = ["the", "and", "of", "people", "house", "größe", "maison"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) + (" nastyword nastily" * 3 if i % 3 == 0 else "") for i in range(240)] + ["", "  ", "nasty"]
    y = [int(i % 3 == 0) for i in range(240)] + [0, 0]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, k int")
    model = toxicity.train(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))

    def weight(word):
        texts, features, _ = toxicity.occurrences(pa.array([word]))
        return sum(model.weights[f] for f in features)

    for r in toxicity.score(docs, model).collect():
        own = [w.encode() for w in texts[r.doc_id].split()]
        linear = sum(weight(w.decode()) for w in own) * 100 / (len(own) + toxicity.SHORT)
        want = [1 / (1 + np.exp(-(linear - t))) for t in model.thresholds]
        assert abs(r.p_mild - want[0]) < 1e-9 and abs(r.p_severe - want[-1]) < 1e-9
        assert r.toxic == (r.p_mild >= 0.5) and (r.doc_id >= len(y) or r.toxic == bool(y[r.doc_id]))
    # a beginning of a longer word only: "nasty" has no feature of 5 bytes, "nastily" has
    count = lambda w: len(toxicity.occurrences(pa.array([w]))[1])
    assert [count(w) for w in ("nast", "nasty", "nastil", "nastywords")] == [1, 2, 3, 6]


def test_best_cut():
    import numpy as np

    assert toxicity.best_cut(np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 1])) == 1.5
    assert toxicity.best_cut(np.array([0.0, 1, 2, 3, 9]), np.array([0.0, 0, 0, 1, 1])) == 2.5
    assert toxicity.best_cut(np.array([0.0, 1, 2, 3, 9]), np.array([0.0, 1, 0, 0, 1])) == 6.0
    assert toxicity.best_cut(np.array([0.0, 0, 0, 0]), np.array([0.0, 1, 0, 1])) is None and toxicity.best_cut(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 0, 0])) is None
    assert toxicity.best_cut(np.array([1.0, 2]), np.array([0.0, 0])) is None


def test_few_labels_leave_clean_documents_alone(spark):
    """Labels that tell nothing, as there are so few: no text is toxic."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    for n in (1, 5, 60):
        labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
        assert toxicity.keep_civil(docs, toxicity.train(docs, labels)).count() == 60


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.range(100, 200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    kept = quality.labelled_sample(docs, labels, "toxic", "text", "doc_id", 60, balanced=True).collect()
    assert len(kept) == 60 and sum(r.y for r in kept) == 30 and all(zlib.crc32(str(r.k).encode()) % 5 for r in kept)


def test_ordinal_grades():
    import numpy as np

    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = np.repeat(np.arange(400), grades)
    features = np.concatenate([np.arange(g) for g in grades]).astype(np.int64)
    w, t = toxicity.fit_ordinal(rows, features, grades, 3)
    p = toxicity.OrdinalModel(w, t).at_least(np.bincount(rows, w[features], 400))
    assert (np.diff(t) > 0).all() and (np.abs(p.sum(1) - grades) < 0.6).mean() > 0.9


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "x" * 100_000, 3), (2, "ok words", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 4 and toxicity.score(docs, toxicity.train(docs, labels)).count() == 4
    assert quality.keep_good(docs, quality.train(docs.limit(0), labels)).columns == docs.columns
    assert toxicity.keep_civil(docs, toxicity.train(docs, labels.limit(0))).count() == 4


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert kept.columns == docs.columns and kept.count() <= docs.count() and kept.join(docs, "doc_id", "left_anti").count() == 0, name
        docs = kept
    assert docs.count() > 50 and corpus_pipeline.encoding_stage(spark, docs, SF).count() == docs.count()


def test_records_name_each_other(spark, tmp_path):
    rows = [(i, f"http://a.b/{i}", "same" if i % 2 else "x" * (100 * i)) for i in range(1, 13)] + [(1, "http://a.b/1", "same"), (8, "http://a.b/8", "x" * 800), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = str(tmp_path / "w")
    warc.write_archives(frame, path, segment_bytes=300)
    files = sorted(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert files and all(p.name.endswith(".warc.gz") for p in files)
    records = [f for p in files for f, _ in warc.parse(p.read_bytes())]
    assert all({"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-length"} <= f.keys() for f in records)
    responses = {f["warc-record-id"] for f in records if f["warc-type"] == "response"}
    assert len([f for f in records if f["warc-type"] == "revisit"]) == 5 and all(f["warc-refers-to"] in responses for f in records if f["warc-type"] == "revisit")
    assert all(f["warc-segment-origin-id"] in responses for f in records if f["warc-type"] == "continuation")
    assert warc.read_archives(spark, path).count() == len(rows)


def test_many_members_are_read_in_linear_time():
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    data = b"".join(warc.member(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{i}>")], head + random.Random(i).randbytes(1500))) for i in range(20_000))
    began = time.time()
    assert sum(1 for _ in warc.parse(data)) == 20_000
    assert time.time() - began < 20


def test_shards_take_further_columns(spark, tmp_path):
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t")
    table.append(spark.createDataFrame([(1, "x")], "id long, a string"))
    table.append(spark.createDataFrame([(2, 0.5)], "id long, b double"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", None), (2, None, 0.5)]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("3",)], "id string"))
    assert table.latest() == 2
    table.append(spark.createDataFrame([(4, "y", 1.5)], "id long, a string, b double"))
    table.compact(target=1 << 20, fan_in=2)
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", None), (2, None, 0.5), (4, "y", 1.5)] and table.manifest().count() == 1
