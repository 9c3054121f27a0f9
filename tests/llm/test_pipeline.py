"""The pipeline's stages against brute force: each is held against plain Python on what its predecessor kept."""

import hashlib
import math
import re
import sys
from bisect import bisect_right
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_brute import brute9, components, shingles

from sieveline.llm import quality, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def plain_features(text):
    """The classifier's features, counted in plain Python."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    blank = b" \t\n\r\x0b\x0c"
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw)
    lines = re.findall(rb"[^\n]+", raw)
    wide = sum(1 for a, b in zip(raw, raw[1:]) if a == 0xC3 and 0x80 <= b <= 0x9E)
    upper = sum(65 <= b <= 90 for b in raw) + wide
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 for b in raw)
    of = lambda chars: sum(b in chars for b in raw)
    w, pairs = max(len(words), 1), [words[:1], *([a, b] for a, b in zip(words, words[1:]))] if words else []
    return [
        math.log1p(len(words)), (len(raw) - of(blank)) / w, upper / max(letters, 1), of(b"#$%&*+/<=>@[\\]^_`{|}~") / len(raw), of(b"|") / len(raw), of(b"!") / len(raw), of(bytes(range(48, 58))) / len(raw),
        of(b".,;:?") / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, math.log1p(len(words) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), of(blank) / len(raw), len(set(map(tuple, pairs))) / w,
    ]


def plain_score(model, x):
    """An additive model's score by a loop over its tables."""
    bins = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, x)]
    logit = model.intercept + sum(t[b] for t, b in zip(model.tables, bins))
    logit += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-logit))


def test_quality_scores_by_plain_loops(spark):
    texts = [None, "", " ", "One two, two. THREE!", "é É ÀÉ x|y || #1", "a\nb\na\n\n c d", "word " * 400, "x" * 5000, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    assert np.allclose(quality.features(pa.array(texts, pa.string())), [plain_features(t) for t in texts])
    rng = np.random.default_rng(1)
    x = np.array([plain_features(t) for t in texts])
    model = quality.fit(x, (x[:, 0] > np.median(x[:, 0])).astype(float), rounds=20, pair_rounds=5, n_bins=8, n_coarse=4)
    assert model.pairs and np.allclose(model.score(x), [plain_score(model, row) for row in x])
    assert ((model.score(x) > 0.5) == (x[:, 0] > np.median(x[:, 0]))).mean() > 0.9
    # one feature, one cut: the first table is what boosting by hand gives
    one = rng.integers(0, 2, 200).astype(float)
    y = np.where(rng.random(200) < 0.9, one, 1 - one)
    small = quality.fit(one[:, None], y, rounds=1, pair_rounds=0, rate=1.0, n_bins=2, lam=1.0)
    base = (y.sum() + 1) / 202
    for value, bin_ in ((0, 0), (1, len(small.tables[0]) - 1)):
        own = y[one == value]
        assert len(small.tables[0]) == 1 or math.isclose(small.tables[0][bin_], (own - base).sum() / (len(own) * base * (1 - base) + 1.0))


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_copies", "decontamination", "encoding"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = quality.train(docs, labels)
    kept = corpus_pipeline.written(stages["quality"](spark, docs, SF), "test")
    assert ids(kept) == sorted(k for k, t in rows.items() if plain_score(model, plain_features(t)) >= 0.3) and kept.columns == docs.columns
    rows = {k: rows[k] for k in ids(kept)}

    civil = toxicity.train(kept, labels)

    def toxic(text):
        texts, features, words = toxicity.occurrences(pa.array([text or ""]))
        return sum(civil.weights[f] for f in features) * 100 / (words[0] + toxicity.SHORT) >= civil.thresholds[0]

    clean = corpus_pipeline.written(stages["toxicity"](spark, kept, SF), "test")
    assert ids(clean) == sorted(k for k, t in rows.items() if not toxic(t)) and clean.columns == docs.columns
    rows = {k: rows[k] for k in ids(clean)}

    keys = sorted(rows)
    own = components([shingles(rows[k]) for k in keys], keys)
    single = corpus_pipeline.written(stages["near_copies"](spark, clean, SF), "test")
    assert ids(single) == [k for k, c in zip(keys, own) if k == c] and single.columns == docs.columns
    rows = {k: rows[k] for k in ids(single)}

    found = brute9(list(rows.items()), bench)
    pure = corpus_pipeline.written(stages["decontamination"](spark, single, SF), "test")
    assert ids(pure) == sorted(k for k in rows if not found[k][4]) and pure.columns == docs.columns
    rows = {k: rows[k] for k in ids(pure)}

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["encoding"](spark, pure, SF).collect()}
    for k, text in rows.items():
        encoded = lib.encode(text or "", add_special_tokens=False).ids
        assert got.pop(k) == (len(encoded), hashlib.sha256(",".join(map(str, encoded)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert not got and len(rows) > 50


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeats, empty and very long texts, columns of clashing names, and empty tables."""
    rows = [(None, None, None, None), (1, "", "x", 1), (1, "", "x", 1), (2, "one two three four five six", None, 2), (2, "one two three four five six", None, 2), (3, "word " * 60_000, "y", 3), (4, "one two three four five six", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, score int")
    spark.createDataFrame([(1, None, 0), (2, 1, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "never seen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, sizes in ((docs, [7, 7, 5, 5, 5]), (docs.limit(0), [0] * 5)):
        for (name, stage), n in zip(corpus_pipeline.STAGES, sizes, strict=True):
            out = corpus_pipeline.written(stage(spark, table, str(tmp_path)), "test")
            assert out.count() == n, name
            if name != "encoding":
                assert out.columns == docs.columns
                table = out
