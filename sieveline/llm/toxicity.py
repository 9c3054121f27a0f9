"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade >= g) = sigmoid(w.x - t_g) with one weight vector for all grades and ordered thresholds t_1 <= t_2 <= ...; the
output is the expected grade. A feature is how often a word, or a word beginning, occurs for each word of the text.

Labels say only whether a text is toxic, so the fit grades the toxic rows itself: the share of marker words, counted with
markers that the other half of the sample has shown, decides; at or above the median is severe (2), below mild (1). The
severity is therefore how thickly such words are strewn, not a grade that somebody has given. The thresholds are moved so
that P(grade >= 1) is a half where rows that were not fitted are told apart best; for that each half is scored by a model
of the other half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_table, hash_words, map_arrow, text_buffer
from .quality import held_out, labelled_sample

#: Words and their beginnings (so many bytes, of longer words) are hashed into so many features.
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Added to the number of words, so that one word in a very short text isn't taken for a habit.
SHORT = 25
#: Bound of the labelled rows that the fit takes, at most half of them toxic; entries of a piece in which the driver sums.
SAMPLE_ROWS = 8_000
PIECE = 1 << 18

LOWER = ascii_lower_table()
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of each word and each beginning of a longer word, and the number of words of each text."""
    raw, offsets = text_buffer(column)
    hashes, firsts, *beginnings = hash_words(LOWER[raw], LETTERS, offsets, PREFIXES)
    texts = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(firsts))
    low = np.uint64((1 << BITS) - 1)
    own, features = [texts], [(hashes & low).astype(np.int32)]
    for i, h in enumerate(beginnings, 1):
        longer = h != hashes
        own.append(texts[longer])
        features.append(((h[longer] >> np.uint64(8 * i)) & low).astype(np.int32))
    return np.concatenate(own), np.concatenate(features), np.diff(firsts)


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the distinct features of each text, in order, and the number of words of each text."""
    texts, features, words = occurrences(column)
    keys, counts = np.unique((texts.astype(np.int64) << BITS) | features, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts, words


def scale_of(words: np.ndarray) -> np.ndarray:
    """What an occurrence counts in a text of so many words."""
    return 100 / (words + SHORT)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of each hashed feature
    thresholds: np.ndarray  # ascending, one for each grade above 0

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each row and g."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -40, 40)))

    def linear(self, column: pa.Array) -> np.ndarray:
        texts, features, words = occurrences(column)
        return (np.bincount(texts, self.weights[features], len(column)) if len(texts) else np.zeros(len(column))) * scale_of(words)


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, n_features: int, values: np.ndarray | None = None, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative link model by Adam; thresholds stay ordered, being a first one and positive steps.

    rows, features, values: the entries of a sparse matrix, ones by default. Returns weights and thresholds."""
    values = np.ones(len(rows)) if values is None else values
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    top = max(top, 1)
    w, base, gaps = np.zeros(n_features), 2.0, np.zeros(top - 1)
    state = [np.zeros(n_features), np.zeros(n_features), np.zeros(top), np.zeros(top)]
    if not n:
        return w, np.full(top, 4.0) + np.arange(top)
    for step in range(1, steps + 1):
        t = base + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        z = np.bincount(rows, values * w[features], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        at = np.arange(n)
        upper, lower = full[at, grades], full[at, grades + 1]
        likely = np.maximum(upper - lower, 1e-9)
        slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
        dz = -(slope_u - slope_l) / likely / n
        dt = np.zeros(top)
        np.add.at(dt, np.maximum(grades - 1, 0), np.where(grades > 0, slope_u / likely / n, 0))
        np.add.at(dt, np.minimum(grades, top - 1), np.where(grades < top, -slope_l / likely / n, 0))
        gw = np.bincount(features, values * dz[rows], n_features) + l2 * w
        tail = np.cumsum(dt[::-1])[::-1]
        gt = np.concatenate([[tail[0]], tail[1:] / (1 + np.exp(-gaps))])
        for k, grad in ((0, gw), (2, gt)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.999 * state[k + 1] + 0.001 * grad**2
        move = [rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.999**step)) + 1e-8) for k in (0, 2)]
        w -= move[0]
        base -= move[1][0]
        gaps -= move[1][1:]
    return w, base + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])


class Sample:
    """The labelled rows as a sparse matrix: text, feature and count of each entry, and words and label of each text. Sums go in pieces, so that the driver holds no long arrays of doubles."""

    def __init__(self, texts: np.ndarray, features: np.ndarray, counts: np.ndarray, words: np.ndarray, toxic: np.ndarray):
        self.texts, self.features, self.counts, self.words, self.toxic = texts, features, counts, words, toxic
        self.scale = scale_of(words)

    def by_feature(self, of_text: np.ndarray, power: int = 1) -> np.ndarray:
        """For each feature the sum over its texts of of_text * value ** power."""
        out = np.zeros(1 << BITS)
        for i in range(0, len(self.texts), PIECE):
            own = slice(i, i + PIECE)
            value = self.counts[own] * self.scale[self.texts[own]]
            out += np.bincount(self.features[own], of_text[self.texts[own]] * value**power, 1 << BITS)
        return out

    def by_text(self, of_feature: np.ndarray) -> np.ndarray:
        """For each text the sum over its features of of_feature * value."""
        out = np.zeros(len(self.words))
        for i in range(0, len(self.texts), PIECE):
            own = slice(i, i + PIECE)
            out += np.bincount(self.texts[own], of_feature[self.features[own]] * self.counts[own], len(out))
        return out * self.scale

    def marks(self, rows: np.ndarray, least: int) -> np.ndarray:
        """How many standard errors the mean value in toxic rows is above that in others, among `rows` (0 or 1 for each text); 0 for features that fewer than `least` rows have."""
        n1, n0 = max((rows * self.toxic).sum(), 1), max((rows * (1 - self.toxic)).sum(), 1)
        held = self.by_feature(rows, 0)
        out = np.zeros(1 << BITS)
        mean, noise = [], []
        for own, n in ((rows * self.toxic, n1), (rows * (1 - self.toxic), n0)):
            m = self.by_feature(own) / n
            mean.append(m)
            # one more occurrence in a text of middling size keeps features of few rows uncertain
            noise.append((self.by_feature(own, 2) / n - m**2 + 1 / n) / n)
        enough = held >= least
        out[enough] = ((mean[0] - mean[1]) / np.sqrt(noise[0] + noise[1]))[enough]
        return out

    def fit(self, rows: np.ndarray, grades: np.ndarray, z: float, least: int) -> OrdinalModel:
        """The regression on `rows`, with the features that lie at least z standard errors apart."""
        chosen = np.flatnonzero(np.abs(self.marks(rows, least)) >= z)
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        number = np.where(rows > 0, np.cumsum(rows > 0) - 1, -1).astype(np.int32)
        entries = []
        for i in range(0, len(self.texts), PIECE):
            own, features = self.texts[i : i + PIECE], place[self.features[i : i + PIECE]]
            at = np.flatnonzero((features >= 0) & (number[own] >= 0))
            entries.append((number[own[at]], features[at], (self.counts[i : i + PIECE][at] * self.scale[own[at]]).astype(np.float32)))
        w, thresholds = fit_ordinal(*(np.concatenate(x) for x in list(zip(*entries, strict=True))[:2]), grades[rows > 0], len(chosen), np.concatenate([x[2] for x in entries]))
        weights = np.zeros(1 << BITS)
        weights[chosen] = w
        return OrdinalModel(weights, thresholds)


def best_cut(linear: np.ndarray, toxic: np.ndarray, most: float = 0.5) -> float | None:
    """The cut with the least sum of both error rates (of equals the highest), in the middle of its gap. None if that sum is above `most`: then the scores tell too little to move a threshold by them."""
    if not len(linear) or not 0 < toxic.sum() < len(toxic):
        return None
    order = np.argsort(linear, kind="stable")
    x, y = linear[order], toxic[order]
    missed = np.concatenate([[0.0], np.cumsum(y)]) / y.sum()
    wrong = 1 - np.concatenate([[0.0], np.cumsum(1 - y)]) / (1 - y).sum()
    total = missed + wrong
    total[1:-1][x[1:] == x[:-1]] = 2.0
    at = len(total) - 1 - int(total[::-1].argmin())
    return float((x[at - 1] + x[at]) / 2) if total[at] <= most else None


def fit(sample: Sample, z: float = 3.0, least: int = 4) -> OrdinalModel:
    """Grades and cut from the other half's markers and model, then the model of all rows. Without toxic or clean rows no text is toxic."""
    toxic, n = sample.toxic, len(sample.words)
    if not 0 < toxic.sum() < n:
        return OrdinalModel(np.zeros(1 << BITS), np.array([4.0, 5.0]))
    half = np.arange(n) % 2
    share, linear = np.zeros(n), np.zeros(n)
    for k in (0, 1):
        marker = (sample.marks((half != k).astype(float), least) >= z).astype(float)
        share = np.where(half == k, sample.by_text(marker), share)
    grades = toxic.astype(np.int64)
    grades += (toxic > 0) & (share >= np.median(share[toxic > 0]))
    for k in (0, 1):
        model = sample.fit((half != k).astype(float), grades, z, least)
        linear = np.where(half == k, sample.by_text(model.weights) - model.thresholds[0], linear)
    model = sample.fit(np.ones(n), grades, z, least)
    cut = best_cut(linear, toxic)
    return model if cut is None else OrdinalModel(model.weights, model.thresholds + cut)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most sample_rows labelled rows that aren't held out (as for quality), at most half of them toxic where there are as many clean ones.

    A text of the sample that has a feature more than 32,767 times is fitted as if it had it so many times; scores count all."""
    sample = labelled_sample(docs, labels, label, text, key, sample_rows, balanced=True)

    def run(batch: pa.RecordBatch):
        texts, features, counts, words = sparse(batch.column(1))
        bounds = pa.array(np.searchsorted(texts, np.arange(batch.num_rows + 1)), pa.int32())
        entries = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((features, pa.int32()), (np.minimum(counts, 32767), pa.int16()))]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(words, pa.int64()), *entries], names=["k", "y", "words", "features", "counts"])

    kind = sample.schema["k"].dataType.simpleString()
    # repeated documents could exceed the bound: the limit holds for them too
    rows = map_arrow(sample, run, f"k {kind}, y int, words long, features array<int>, counts array<short>").orderBy(F.xxhash64("k"), "k", "words", "y").limit(sample_rows)

    def fitted(batches):
        table = pa.Table.from_batches(held).combine_chunks() if (held := [b for b in batches if b.num_rows]) else None
        model = fit(_sample_of(table))
        chosen = np.flatnonzero(model.weights)
        yield pa.record_batch([pa.array([x], pa.list_(kind)) for x, kind in ((chosen, pa.int32()), (model.weights[chosen], pa.float64()), (model.thresholds, pa.float64()))], names=["features", "weights", "thresholds"])

    # the bounded sample is fitted in one task: the driver gets the model alone
    model = rows.mapInArrow(fitted, "features array<int>, weights array<double>, thresholds array<double>").first()
    if model is None:
        return fit(_sample_of(None))
    weights = np.zeros(1 << BITS)
    weights[np.array(model["features"], np.int64)] = model["weights"]
    return OrdinalModel(weights, np.array(model["thresholds"]))


def _sample_of(table: pa.Table | None) -> Sample:
    if table is None:
        return Sample(*[np.zeros(0, np.int64)] * 5)
    features, counts = (table.column(c).combine_chunks() for c in ("features", "counts"))
    sizes = pa.compute.list_value_length(features).to_numpy(zero_copy_only=False).astype(np.int64)
    toxic, words = (table.column("y").to_numpy() > 0).astype(float), table.column("words").to_numpy()
    return Sample(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), features.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False), words, toxic)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row: key, held_out, severity (expected grade), p_mild and p_severe (of that grade or more), toxic (p_mild >= threshold).

    Null and empty texts have no words, so they get the thresholds' base rate. One pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        p = shared.value.at_least(shared.value.linear(batch.column(1)))
        yield pa.record_batch([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p[:, 0] >= threshold)], names=["key", "severity", "p_mild", "p_severe", "toxic"])

    out = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, severity double, p_mild double, p_severe double, toxic boolean")
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "severity", "p_mild", "p_severe", "toxic")


def keep_civil(docs: DataFrame, model: OrdinalModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that aren't toxic at the threshold.

    Null and empty texts have no words and are scored by the thresholds alone, very long ones whole; repeated rows stay or go
    together; columns may have any names; an empty table stays empty."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        p = shared.value.at_least(shared.value.linear(batch.column(at)))[:, 0]
        yield batch.filter(pa.array(p < threshold))

    return map_arrow(docs, run, docs.schema)
