"""Training of byte-pair merges on weighted words, distributed: words stay on the executors, the driver holds pairs and their counts.

A shard is one row: the symbols of its words end to end (-1 behind each word) and the words' counts. A round applies a batch of merges
to every shard and sums how the counts of pairs change in the words that it touches; the driver's queue of pairs gives the next batch.

A batch is the longest run of the most frequent pairs in which none begins with what another ends with, so that they can't overlap.
None of them changes the count of another, and none makes a pair that should have come before a later one: a new pair is at most as
frequent as the old one it stems from, which overlaps with the batch and so stands behind all of it, and of equals a new symbol has
the larger number. So the merges are those of one merge at a time. What the driver holds is bounded by the square of the vocabulary,
whatever the number of words.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_paths, written

#: Characters of a shard, about; rounds after which the shards are written with their merges applied.
SHARD_CHARS, ROUNDS = 4 << 20, 6
_SHARD = "symbols binary, counts binary"
_DELTA = "pair long, change long"


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums of weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.add.reduceat(weights[order], first)


def pairs_of(symbols: np.ndarray, counts: np.ndarray, base: int, touched: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours (a * base + b) with the counts of their words summed; of touched words only, if given."""
    word = np.cumsum(symbols < 0)
    at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0)) if len(symbols) else np.zeros(0, np.int64)
    if touched is not None:
        at = at[touched[word[at]]]
    return _summed(symbols[at].astype(np.int64) * base + symbols[at + 1], counts[word[at]])


def _places(symbols: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of a batch of merges (a, b, new) stand, overlapping ones too, and what each becomes."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = max(int(symbols.max(initial=0)), *(max(a, b) for a, b, _ in batch)) + 2
    keys, new = np.array(sorted((a * base + b, made) for a, b, made in batch), np.int64).T
    first = np.zeros(base + 1, bool)
    first[[a for a, _, _ in batch]] = True
    left = np.flatnonzero(first[symbols[:-1]])  # -1 looks up the last place, which is False
    pair = symbols[left].astype(np.int64) * base + symbols[left + 1]
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    some = keys[at] == pair
    return left[some], new[at[some]]


def merged(symbols: np.ndarray, batch: list[tuple[int, int, int]], counts: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols after a batch of merges (a, b, new) that can't overlap, and which of so many words were touched."""
    touched = np.zeros(counts, bool)
    left, new = _places(symbols, batch)
    if len(left):
        # in a run of equal symbols every second place merges, from the left; other pairs can't overlap
        runs = np.r_[True, left[1:] != left[:-1] + 1]
        start = np.maximum.accumulate(np.where(runs, np.arange(len(left)), 0))
        some = (np.arange(len(left)) - start) % 2 == 0
        left, new = left[some], new[some]
        touched[np.searchsorted(np.flatnonzero(symbols < 0), left)] = True
        out = symbols.copy()
        out[left] = new
        keep = np.ones(len(out), bool)
        keep[left + 1] = False
        symbols = out[keep]
    return symbols, touched


def holding(symbols: np.ndarray, counts: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold a pair of the batch, and their counts: most rounds touch few words, so the others are not looked at again."""
    ends = np.flatnonzero(symbols < 0)
    some = np.unique(np.searchsorted(ends, _places(symbols, batch)[0]))
    starts = np.where(some > 0, ends[some - 1] + 1, 0)
    lengths = ends[some] + 1 - starts
    before = np.cumsum(lengths) - lengths
    return symbols[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], counts[some]


def _shards(words: DataFrame, ids: dict[int, int], base: int, chars: int) -> DataFrame:
    """Shards of the words (word, count), of about SHARD_CHARS characters each."""
    spark = words.sparkSession
    codes = np.array(sorted(ids), np.int64)
    lookup = spark.sparkContext.broadcast((codes, np.array([ids[c] for c in codes.tolist()], np.int32)))
    n = max(chars // SHARD_CHARS + 1, min(spark.sparkContext.defaultParallelism, chars // 50_000 + 1))

    def pack(batches):
        known, number = lookup.value
        symbols, counts = [], []
        for b in batches:
            letters = np.frombuffer("\n".join([*b.column(0).to_pylist(), ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
            symbols.append(np.where(letters == 10, -1, number[np.minimum(np.searchsorted(known, letters), len(known) - 1)]).astype(np.int32))
            counts.append(b.column(1).to_numpy().astype(np.int64))
        if counts:
            yield pa.record_batch([pa.array([np.concatenate(symbols).tobytes()], pa.binary()), pa.array([np.concatenate(counts).tobytes()], pa.binary())], names=["symbols", "counts"])

    return words.repartition(int(n), "word").mapInArrow(pack, _SHARD)


def _arrays(batches):
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield np.frombuffer(s, np.int32), np.frombuffer(c, np.int64)


def _applied(shards: DataFrame, batches: list[list[tuple[int, int, int]]]) -> DataFrame:
    """The shards with batches of merges applied."""

    def run(rows):
        for symbols, counts in _arrays(rows):
            for batch in batches:
                symbols, _ = merged(symbols, batch, len(counts))
            yield pa.record_batch([pa.array([symbols.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["symbols", "counts"])

    return shards.mapInArrow(run, _SHARD)


def _changes(shards: DataFrame, batches: list[list[tuple[int, int, int]]], base: int) -> DataFrame:
    """How the last batch changes the counts of pairs; without batches, the counts. pair, change."""

    def run(rows):
        for symbols, counts in _arrays(rows):
            for batch in batches[:-1]:
                symbols, _ = merged(symbols, batch, len(counts))
            if not batches:
                keys, sums = pairs_of(symbols, counts, base)
            else:
                words, often = holding(symbols, counts, batches[-1])
                old, new = pairs_of(words, often, base), pairs_of(merged(words, batches[-1], len(often))[0], often, base)
                keys, sums = _summed(np.r_[old[0], new[0]], np.r_[-old[1], new[1]])
            some = sums != 0
            yield pa.record_batch([pa.array(keys[some]), pa.array(sums[some])], names=["pair", "change"])

    return shards.mapInArrow(run, _DELTA).groupBy("pair").agg(F.sum("change").alias("change")).where("change <> 0")


class Pairs:
    """Counts of pairs and the queue of the most frequent; of equals the one with the smaller ids comes first."""

    def __init__(self, keys: list[int], counts: list[int], base: int, least: int):
        self.total = dict(zip(keys, counts))
        self.queue = [(-c, k) for k, c in self.total.items()]
        heapify(self.queue)
        self.base, self.least = base, least

    def change(self, keys: list[int], changes: list[int]) -> None:
        for k, c in zip(keys, changes):
            now = self.total.get(k, 0) + c
            if now > 0:
                self.total[k] = now
                heappush(self.queue, (-now, k))
            else:
                self.total.pop(k, None)

    def batch(self, most: int, texts: list[str], vocab: dict[str, int]) -> list[tuple[int, int, int]]:
        """The next merges, which can't overlap; texts and vocab get the new tokens. A merge whose token is there already is the last of its batch, as it makes no new symbol."""
        out, begun, ended, chosen = [], set(), set(), set()
        while self.queue and len(out) < most:
            top, key = self.queue[0]
            if -top != self.total.get(key, 0) or key in chosen:
                heappop(self.queue)
                continue
            a, b = divmod(key, self.base)
            if -top < self.least or a in ended or b in begun:
                break
            heappop(self.queue)
            chosen.add(key)
            begun.add(a)
            ended.add(b)
            text = texts[a] + texts[b]
            known = text in vocab
            made = vocab.setdefault(text, len(vocab))
            if not known:
                texts.append(text)
            out.append((a, b, made))
            if known:
                break
        return out


def letters_of(words: DataFrame) -> list[int]:
    """Code points of all words in order; at most as many as there are characters."""

    def run(batches):
        for b in batches:
            codes = np.unique(np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le"), np.uint32))
            yield pa.record_batch([pa.array(codes.astype(np.int64))], names=["code"])

    return sorted(r["code"] for r in words.select("word").mapInArrow(run, "code long").distinct().collect())


def merges(words: DataFrame, size: int, special: list[str], least: int = 2) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of the words (word, count; no blanks in words): always the most frequent pair, of equals the one with the smaller ids.

    Ids run over the special tokens, the characters by code and the merged tokens. Null and empty words don't count."""
    spark, made = words.sparkSession, []
    words = written(words.select("word", F.col("count").cast("long").alias("count")).where(F.length("word") > 0), "bpe-words", made)
    vocab: dict[str, int] = {}
    for token in special:
        vocab.setdefault(token, len(vocab))
    letters = letters_of(words)
    for c in letters:
        vocab.setdefault(chr(c), len(vocab))
    texts = list(vocab)
    base = max(size, len(vocab)) + 1
    chars = words.agg(F.sum(F.length("word")).alias("n")).first()["n"] or 0
    state: list[str] = []
    shards = written(_shards(words, {c: vocab[chr(c)] for c in letters}, base, chars), "bpe-shards", state)
    first = _changes(shards, [], base).toArrow()
    pairs = Pairs(first.column("pair").to_pylist(), first.column("change").to_pylist(), base, least)
    out: list[tuple[str, str]] = []
    since: list[list[tuple[int, int, int]]] = []
    while len(vocab) < size:
        batch = pairs.batch(size - len(vocab), texts, vocab)
        if not batch:
            break
        out += [(texts[a], texts[b]) for a, b, _ in batch]
        since.append(batch)
        if len(vocab) >= size:
            break
        found = _changes(shards, since, base).toArrow()
        pairs.change(found.column("pair").to_pylist(), found.column("change").to_pylist())
        if len(since) >= ROUNDS:
            old, state = state, []
            shards, since = written(_applied(shards, since), "bpe-shards", state), []
            drop_paths(spark, old)
    drop_paths(spark, made + state)
    return vocab, out
