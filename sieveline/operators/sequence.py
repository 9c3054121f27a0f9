"""A small network over token sequences, trained data-parallel: embeddings of tokens and of neighbouring pairs, averaged, a hidden
layer, two logits. Order counts by the pairs.

Training goes in rounds. In a round each worker partition takes the weights of the last step, runs over its rows in small batches, and
returns its weights; their average, by rows, is the next step, which is written. A task that is lost is run again from the written
step; a job that is lost goes on from the last one."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_paths, written
from .inference import ModelStore

#: The seed of Spark's xxhash64.
SEED = 42


def features(tokens: Column, buckets: int) -> Column:
    """Numbers of a sequence's tokens and of its neighbouring pairs."""
    one = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    pair = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, pair)


def numbers(window: list[str], buckets: int) -> np.ndarray:
    """features() of one window in a worker."""
    import xxhash

    words = [w.encode() for w in window]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64_intdigest(w, SEED) for w in words]
    pair = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, words[1:])]
    return np.array([signed(h) % buckets for h in [*one, *pair]], np.int64)


class SequenceModel:
    """The weights, and the contract of inference.predict(): logits for windows."""

    def __init__(self, buckets: int, dim: int, hidden: int, seed: int = 0):
        r = np.random.default_rng(seed)
        self.buckets = buckets
        self.weights = [r.normal(0, 0.5, (buckets, dim)), r.normal(0, 0.5, (dim, hidden)), np.zeros(hidden), r.normal(0, 0.5, hidden), np.zeros(1)]

    def forward(self, flat: np.ndarray, lengths: np.ndarray) -> tuple:
        """Means of embeddings, hidden values and the malicious logit, for sequences end to end; all have numbers."""
        e, a, b, c, d = self.weights
        first = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(e[flat], first, axis=0) / lengths[:, None]
        hidden = np.tanh(mean @ a + b)
        return mean, hidden, hidden @ c + d[0]

    def step(self, flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch."""
        e, a, b, c, d = self.weights
        mean, hidden, z = self.forward(flat, lengths)
        gz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gh = gz[:, None] * c * (1 - hidden**2)
        gm = (gh @ a.T) / lengths[:, None]
        c -= rate * (hidden.T @ gz)
        d -= rate * gz.sum()
        a -= rate * (mean.T @ gh)
        b -= rate * gh.sum(0)
        # embeddings have few uses in a batch each, so their steps are longer
        np.add.at(e, flat, -rate * len(y) * np.repeat(gm, lengths, axis=0))

    def logits(self, windows: list[list[str]]) -> list[tuple[float, float] | None]:
        found = [numbers(w, self.buckets) for w in windows]
        some = [i for i, f in enumerate(found) if len(f)]
        out: list[tuple[float, float] | None] = [None] * len(windows)
        if some:
            *_, z = self.forward(np.concatenate([found[i] for i in some]), np.array([len(found[i]) for i in some]))
            for i, v in zip(some, z.tolist()):
                out[i] = (0.0, v)
        return out


def train_sequence(rows: DataFrame, tokens: str, label: str, steps: ModelStore, rounds: int = 8, workers: int = 8, buckets: int = 1 << 12, dim: int = 8, hidden: int = 8, rate: float = 0.5, batch: int = 32, seed: int = 0) -> SequenceModel:
    """The model after so many rounds over rows (tokens as an array, label 0 or 1). Steps are kept in `steps` as step-0001 and so on; a call
    with steps there goes on behind the last. Rows without tokens or label don't count; without rows the model stays as it began.

    The driver holds the weights of `workers` partitions at a time, whatever the number of rows."""
    made: list[str] = []
    data = rows.where(F.col(label).isNotNull() & (F.size(tokens) > 0)).select(features(F.col(tokens), buckets).alias("x"), F.col(label).cast("double").alias("y"))
    data = written(data.repartition(workers, F.xxhash64("x")).withColumn("worker", F.spark_partition_id()).sortWithinPartitions(F.xxhash64("x", "y")), "sequence-rows", made)
    have = [v for v in steps.versions() if v.startswith("step-")]
    model = steps.load(have[-1]) if have else SequenceModel(buckets, dim, hidden, seed)
    for number in range(len(have), rounds):
        shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))

        def run(batches, shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            own, n = pickle.loads(shared.value), 0
            x, y = [], []
            for b in batches:
                x += b.column(0).to_pylist()
                y += b.column(1).to_pylist()
                while len(x) >= batch:
                    own.step(np.concatenate([np.array(r, np.int64) for r in x[:batch]]), np.array([len(r) for r in x[:batch]]), np.array(y[:batch]), rate / (1 + number / 4))
                    n, x, y = n + batch, x[batch:], y[batch:]
            if x:
                own.step(np.concatenate([np.array(r, np.int64) for r in x]), np.array([len(r) for r in x]), np.array(y), rate / (1 + number / 4))
                n += len(x)
            if n:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([pickle.dumps(own.weights)], pa.binary())], names=["n", "weights"])

        found = data.repartition(workers, "worker").sortWithinPartitions("worker", F.xxhash64("x", F.lit(number)), "x", "y").select("x", "y").mapInArrow(run, "n long, weights binary").orderBy("n", "weights").collect()
        total = sum(r["n"] for r in found)
        if total:
            each = [(r["n"] / total, pickle.loads(bytes(r["weights"]))) for r in found]
            model.weights = [sum(w * p[k] for w, p in each) for k in range(len(model.weights))]
        shared.unpersist()
        steps.save(f"step-{number + 1:04}", model)
    drop_paths(rows.sparkSession, made)
    return model
