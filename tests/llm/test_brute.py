"""Results against plain Python on small fixtures with nulls, ties, repeats, empty and long texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, jaccard, topk

WORDS = ["the", "thand", "Über", "été", "ing", "on", "x1", "!!", "Foo,", "bar.", "zz9"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "b", "c", "7"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = sentence(rng, 30)
    out = [None, "", " \t\n ", "one", "one", "One two", "a b c d", "a b c d e", "é x y z w"]
    bases = [sentence(rng, rng.choice([6, 20, 60, 120])) for _ in range(25)]
    for base in bases:
        out.append(base)
        for _ in range(rng.randint(0, 6)):
            words = base.split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    out += [sentence(rng, 10) + " " + passage + " " + sentence(rng, rng.choice([1, 5, 40])) for _ in range(25)]
    out += [passage] * 12 + [passage.upper()] * 3 + [sentence(rng, 6000)]
    return out


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets, keys):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    parent[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), keys[i]), keys[i])
    return [least[root(i)] if sets[i] else keys[i] for i in range(len(sets))]


def test_near_copies(spark, texts):
    keys = [1000 - 7 * i for i in range(len(texts))]
    docs = spark.createDataFrame([(k, t, "s", "junk") for k, t in zip(keys, texts)], "doc_id long, text string, digest string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(docs).collect()}
    sets = [shingles(t) for t in texts]
    want = {k: (len(s), c) for k, s, c in zip(keys, sets, components(sets, keys))}
    assert got == want
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {k for k, (n, c) in want.items() if k == c}
    assert jaccard.keep_one(docs).columns == docs.columns


def test_near_copies_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "CROWD", 3)
    keys = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == dict(zip(keys, components([shingles(t) for t in texts], keys)))


@pytest.mark.parametrize("tokens", [60, 400])
def test_near_copies_small_groups(spark, texts, monkeypatch, tokens):
    """Connected parts that are dealt into several groups, and few sketches, so that the matrix has to find most links."""
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "FREQUENT_SETS", 2)
    keys = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == dict(zip(keys, components([shingles(t) for t in texts], keys)))


def test_groups_are_opened_by_bounds():
    """A query meets the classes of a group only if the group's union holds enough of it; the link found is a true one."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
    sets = []
    for _ in range(12):
        own = base.copy()
        own[rng.choice(len(own), rng.integers(0, 25), replace=False)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        sets.append(np.unique(own))
    group = jaccard.Group(*jaccard.packed_group(list(range(12)), sets), 75)
    assert [(d, s.tolist()) for d, s in group.sets()] == [(i, s.tolist()) for i, s in enumerate(sets)]
    for _ in range(300):
        query = np.unique(np.concatenate([rng.choice(base, rng.integers(1, 80), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64)]))
        links = [i for i, s in enumerate(sets) if 100 * (n := len(np.intersect1d(s, query))) >= 75 * (len(s) + len(query) - n)]
        found = group.link(query)
        assert (found is None and not links) or found in links


def test_keep_one_with_clashing_names(spark):
    names = ["doc_id", "text", "digest", "__digest", "k", "c0", "component_id", "n", "r", "again_k"]
    rows = [(1, "a b c d e f", *[None] * 8), (1, "a b c d e f", *["x"] * 8), (2, "a b c d e f", *["y"] * 8), (3, None, *["z"] * 8), (4, "", *["z"] * 8)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if i == 0 else 'string'}" for i, n in enumerate(names)))
    kept = jaccard.keep_one(docs)
    assert kept.columns == names and sorted(r[0] for r in kept.collect()) == [1, 3, 4]


def test_near_copies_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "q")], "doc_id long, text string")
    rows = sorted(((str(r.doc_id), r.component_id) for r in jaccard.near_copies(docs).collect()), key=str)
    assert rows == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", 1), ("None", None)]
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["1", "3", "None"]
    assert jaccard.near_copies(docs.limit(0)).count() == 0
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def item_windows(text, width=10):
    w = words9(text)
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []


def words9(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute9(docs, items):
    out = {}
    for k, text in docs:
        w, hit, names = words9(text), set(), set()
        for i, item in items:
            for win in item_windows(item):
                for at in range(len(w) - len(win) + 1):
                    if tuple(w[at : at + len(win)]) == win:
                        hit |= set(range(at, at + len(win)))
                        names |= {str(i)} if i is not None else set()
        out[k] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontaminate(spark, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 700)
    rng = random.Random(1)
    some = [t for t in texts if t]
    items = [(i, t) for i, t in enumerate(["", None, "zz9", "One two", "foo bar", some[30], some[30].upper() + " more", *(" ".join(rng.choice(some).split(" ")[3:16]) for _ in range(12)), sentence(rng, 14)])]
    items += [(5, some[40]), (None, some[41]), (12, "été")]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, mask int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(decontaminate.annotate(frame, bench, block_bytes=block)).collect()}
    want = brute9(docs, items)
    assert got == want
    assert {r.doc_id for r in decontaminate.remove_contaminated(frame, bench, block_bytes=block).collect()} == {k for k, v in want.items() if not v[4]}


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_longest_matches_and_their_places(spark, block):
    """Longest verbatim matches of ten words and more, or of whole shorter items, against a search of all pairs of places."""
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(n))) for i, n in enumerate([14, 25, 3, 1, 0, 40])]
    docs = []
    for k in range(30):
        words = [rng.choice(["x", "y", "a", "bb"]) for _ in range(rng.randint(0, 20))]
        own = items[rng.choice([0, 1, 5])][1].split()
        at = rng.randint(0, max(0, len(own) - 12))
        docs.append((k, " ".join(words + own[at : at + rng.randint(8, 40)] + words + own[:12])))
    frame = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.annotate(frame, bench, block_bytes=block, locations=True).collect()}
    for k, text in docs:
        w, want = words9(text), []
        for i, item in items:
            v = words9(item)
            least = min(10, len(v))
            for x in range(len(w)):
                for y in range(len(v)):
                    if x and y and w[x - 1] == v[y - 1]:
                        continue
                    n = 0
                    while x + n < len(w) and y + n < len(v) and w[x + n] == v[y + n]:
                        n += 1
                    if n >= least:
                        want.append((str(i), y, x, n))
        assert sorted(got[k]) == sorted(want), (text, items)
    assert got[99] == []


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert [r.n_hit for r in decontaminate.annotate(docs, bench).collect()] == [0, 0]
    assert decontaminate.annotate(docs.limit(0), bench).count() == 0


def test_top_inner_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(50, [0.1, None, 0.2]), (100, None), (3, [float("nan")] * 8), (400, [float("inf")] * 8), (None, rows[7][1]), (150, rows[9][1]), (200, [2.0]), (250, [])]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    fine = [(k, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, (q, a) in enumerate(fine):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), -1 if k is None else k, k is not None, k) for j, (k, b) in enumerate(fine) if j != i)
            want += [(q, r, k, -s) for r, (s, _, _, k) in enumerate(scored[:5], 1)]
    for block in (16384, 37):
        got = [tuple(r) for r in topk.top_inner_products(frame, block_rows=block, chunk_bytes=200 if block == 37 else 1 << 20).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert topk.top_inner_products(frame.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [8.0e6] * 4), (1, [1.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_inner_products(large)
    fits = spark.createDataFrame([(0, [2.0e5, -3.0e5]), (1, [1.5e5, 2.5e5]), (2, [-2.0e5, 1.0e5])], "vec_id long, embedding array<double>")
    want = sorted((-(256 * 256) * int(2.0e5 * x - 3.0e5 * y), i) for i, x, y in ((1, 1.5e5, 2.5e5), (2, -2.0e5, 1.0e5)))
    assert [(r.vec_id, r.score) for r in topk.top_inner_products(fits).orderBy("rank").collect()] == [(i, -n) for n, i in want]
    few = spark.createDataFrame([(0, [1.0, -2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_inner_products(few).collect()] == [(0, 1, 1, 256 * 128 - 512 * 128)]
