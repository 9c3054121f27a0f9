"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned; cyclic boosting of shallow trees learns a table for each feature and for the strongest pairs; a score
is the sum of the entries of a row's bins. Only a bounded sample of labelled rows reaches the driver, for fitting.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_arrow, text_buffer

FEATURES = ["log_words", "word_length", "upper", "symbols", "bars", "shouts", "digits", "stops", "distinct_words", "repeats_in_place", "line_length", "distinct_lines", "blank", "distinct_pairs"]
#: Bound of the labelled rows that the fit takes.
SAMPLE_ROWS = 20_000


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


BLANK = _table(b" \t\n\r\x0b\x0c")
CLASSES = {
    "upper": _table(bytes(range(65, 91))), "letters": _table(bytes([*range(65, 91), *range(97, 123), 0xC3])), "symbols": _table(b"#$%&*+/<=>@[\\]^_`{|}~"), "bars": _table(b"|"),
    "shouts": _table(b"!"), "digits": _table(bytes(range(48, 58))), "stops": _table(b".,;:?"), "lines": _table(b"\n"), "blank": BLANK, "wide_lead": _table(b"\xc3"),
}


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    texts = np.repeat(np.arange(len(firsts) - 1, dtype=np.uint64), np.diff(firsts))
    keys = np.sort((texts << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=len(firsts) - 1)


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text; null counts as empty, whose features are all 0."""
    raw, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), len(FEATURES)))
    if not len(raw):
        return out

    def count(table: np.ndarray, of: np.ndarray = raw) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[of], out=sums[1:])
        return np.diff(sums[offsets]).astype(float)

    n = {k: count(t) for k, t in CLASSES.items()}
    # capitals of Latin-1 are C3 80 to C3 9E
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(wide, out=sums[1:])
    upper = n["upper"] + np.diff(sums[offsets])
    hashes, firsts = hash_words(raw, ~BLANK, offsets)
    words = np.diff(firsts).astype(float)
    line_table = np.ones(256, bool)
    line_table[10] = False
    line_hashes, line_firsts = hash_words(raw, line_table, offsets)
    lines = np.diff(line_firsts).astype(float)
    pairs = hashes.copy()
    twice = np.zeros(len(hashes), bool)
    if len(hashes):
        pairs[1:] += hashes[:-1] * np.uint64(3)
        twice[1:] = hashes[1:] == hashes[:-1]
        inner = firsts[:-1][firsts[:-1] < len(hashes)]
        pairs[inner] = hashes[inner]
        twice[inner] = False
    totals = np.zeros(len(hashes) + 1)
    np.cumsum(twice, out=totals[1:])
    one = np.maximum(sizes, 1)
    w = np.maximum(words, 1)
    values = {
        "log_words": np.log1p(words), "word_length": (sizes - n["blank"]) / w, "upper": upper / np.maximum(n["letters"], 1), "symbols": n["symbols"] / one, "bars": n["bars"] / one,
        "shouts": n["shouts"] / one, "digits": n["digits"] / one, "stops": n["stops"] / w, "distinct_words": _distinct(hashes, firsts) / w, "repeats_in_place": np.diff(totals[firsts]) / w,
        "line_length": np.log1p(words / np.maximum(lines, 1)), "distinct_lines": _distinct(line_hashes, line_firsts) / np.maximum(lines, 1), "blank": n["blank"] / one, "distinct_pairs": _distinct(pairs, firsts) / w,
    }
    for j, name in enumerate(FEATURES):
        out[:, j] = values[name]
    out[sizes == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Lookup tables over the bins of features and of pairs of features."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Best split of bins with gradient and hessian sums: gain and the first bin on the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
    gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int = 3) -> np.ndarray:
    """A shallow tree on one feature's bins, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_cut(g[a:b], h[a:b], lam), a, b) for a, b in parts if b - a > 1), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """A tree of one split on the first feature and one on the second in each half; the gain over no split, and its values."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + lam)
    for at in range(1, len(g)):
        gain, cuts = -base, []
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            more, cut = _cut(gs, hs, lam)
            gain += gs.sum() ** 2 / (hs.sum() + lam) + more
            cuts.append((rows, cut, gs, hs))
        if gain > best:
            best, out = gain, np.zeros_like(g)
            for rows, cut, gs, hs in cuts:
                for cols in (slice(0, cut), slice(cut, None)):
                    if gs[cols].size:
                        out[rows, cols] = -gs[cols].sum() / (hs[cols].sum() + lam)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, n_bins: int = 32, n_coarse: int = 8, lam: float = 1.0) -> AdditiveModel:
    """Cyclic boosting: in each round each feature in turn adds a small tree to its table, then likewise the strongest pairs."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(edges, float(np.log(rate_of_ones / (1 - rate_of_ones))))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    model.coarse = [np.minimum(np.arange(len(e) + 1) * n_coarse // (len(e) + 1), n_coarse - 1) for e in edges]
    if not len(x):
        return model
    b = model.bins(x)
    logit = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) == 1:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), lam)
            table += step
            logit += step[b[:, j]]
    c = np.stack([m[b[:, j]] for j, m in enumerate(model.coarse)], 1)

    def sums(i, j):
        g, h = slopes()
        flat = c[:, i] * n_coarse + c[:, j]
        return [np.bincount(flat, v, n_coarse * n_coarse).reshape(n_coarse, n_coarse) for v in (g, h)]

    gains = sorted(((_pair_tree(*sums(i, j), lam)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((n_coarse, n_coarse))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _pair_tree(*sums(i, j), lam)[1]
            table += step
            logit += step[c[:, i], c[:, j]]
    return model


def held_out(key: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, rows: int, balanced: bool = False) -> DataFrame:
    """(k, text, y) of at most `rows` labelled documents that aren't held out, first by a hash of the id: the bound makes the broadcast safe.

    Only labels of documents that are there count. If balanced, at most half are of label 1 and above, unless other rows don't fill the rest."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    usable = usable.join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    first = lambda of, n: of.orderBy(F.xxhash64("k"), "k", "y").limit(n)
    chosen = first(usable.where("y > 0"), rows // 2).unionByName(first(usable.where("y <= 0"), rows - rows // 2)) if balanced else first(usable, rows)
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("k", "text", "y")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most sample_rows labelled rows that aren't held out. Without labels the model scores all texts alike.

    Null labels and labels with a null id or of absent documents don't count; null texts are fitted as empty ones; a document
    or label that is repeated counts as often as it is there."""
    sample = labelled_sample(docs, labels, label, text, key, sample_rows)

    def run(batch: pa.RecordBatch):
        x = features(batch.column(1))
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    kind = sample.schema["k"].dataType.simpleString()
    # repeated documents could exceed the bound: the limit holds for them too
    rows = map_arrow(sample, run, f"k {kind}, y int, x array<double>").orderBy(F.xxhash64("k"), "k", "x", "y").limit(sample_rows)

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        x = np.concatenate([np.zeros((0, len(FEATURES))), *(b.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)) for b in held)])
        y = np.concatenate([np.zeros(0), *(b.column(1).to_numpy().astype(float) for b in held)])
        yield pa.record_batch([pa.array([pickle.dumps(fit(x, y))], pa.binary())], names=["model"])

    # the bounded sample is fitted in one task: the driver gets the model alone
    model = rows.mapInArrow(fitted, "model binary").first()
    return fit(np.zeros((0, len(FEATURES))), np.zeros(0)) if model is None else pickle.loads(bytes(model["model"]))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Per row: key, held_out, score in 0 to 1, predicted (1 if score >= threshold). Null counts as the empty text, which is scored as well. One pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        p = shared.value.score(features(batch.column(1)))
        yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["key", "score", "predicted"])

    out = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, score double, predicted int")
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold.

    Null and empty texts are scored as empty ones, very long ones whole; repeated rows stay or go together; columns may have
    any names; an empty table stays empty."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(shared.value.score(features(batch.column(at))) >= threshold))

    return map_arrow(docs, run, docs.schema)
