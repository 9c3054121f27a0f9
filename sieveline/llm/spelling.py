"""Spelling variants: words that differ in one letter, found by hashes of their deletions.

A word has as many different deletions as runs of equal letters. Polynomial hashes of all prefixes and suffixes give the key of
each deletion by vectorised NumPy arithmetic (modulo two primes, 62 bits), without building the strings. Keys are partitioned by
their upper bits and sorted; words whose keys meet are candidates, and only these get their strings, on which every meeting is
verified. Two words of equal length are near if they meet by a deletion at the same place; a word is near to a longer one if its
whole meets a deletion of that. No group is larger than the alphabet times the length of a word, whatever the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Letters of a word, and the two primes and bases of the hashes.
LETTERS = "[A-Za-zÀ-ÿ]+"
_PRIMES, _BASES = (2147483647, 2147483629), (1000003, 69069069)
#: Keys that a task sorts at once, about 24 bytes each.
BUCKET_ROWS = 1 << 19


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word and n: the runs of letters of all texts, A-Z lower-cased, that occur often enough.

    A run whose crc32 of `<doc_id>:<run>` is divisible by `every` loses its letter at that hash modulo its length (so the corpus has
    spelling errors to find). Null texts have no words; a null doc_id counts as empty."""
    text = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(which: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo the prime."""
    have, prime = _POWERS[which], np.uint64(_PRIMES[which])
    while len(have) < n:
        following = np.uint64(pow(_BASES[which], len(have), _PRIMES[which]))
        have = np.concatenate((have, have * following % prime))
    _POWERS[which] = have
    return have


def deletion_keys(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words as code points end to end: number of the word, key, first and last place whose deletion gives the key.

    The whole word's key has the places -1. Equal letters in a row share one deletion, and so one row."""
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(letters)) - starts[word]
    key_del, key_whole = np.zeros(len(letters), np.int64), np.zeros(len(lengths), np.int64)
    for which in (0, 1):
        prime, power = np.uint64(_PRIMES[which]), _powers(which, int(lengths.max(initial=1)) + 1)
        c = letters.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(c * power[place] % prime, out=prefix[1:])
        suffix = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(np.where(place > 0, c * power[np.maximum(place - 1, 0)] % prime, np.uint64(0)), out=suffix[1:])
        i, end = np.arange(len(letters)), (starts + lengths)[word]
        deleted = (prefix[i] - prefix[starts[word]] + suffix[end] - suffix[i + 1]) % prime
        whole = (prefix[starts + lengths] - prefix[starts]) % prime
        key_del, key_whole = key_del << 31 | deleted.astype(np.int64), key_whole << 31 | whole.astype(np.int64)
    first = np.flatnonzero((place == 0) | np.concatenate(([True], letters[1:] != letters[:-1]))[: len(letters)])
    last = np.concatenate((first[1:], [len(letters)]))[: len(first)] - 1
    none = np.full(len(lengths), -1)
    return np.concatenate((np.arange(len(lengths)), word[first])), np.concatenate((key_whole, key_del[first])), np.concatenate((none, place[first])), np.concatenate((none, place[last]))


_KEYS = "wid long, key long, first int, last int"


def _keys(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = b.column("word").to_pylist()
        at = 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and (size < 1 << 18 or to == at):  # long words come in small groups
                size, to = size + len(words[to]), to + 1
            some = words[at:to]
            letters = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
            number, key, first, last = deletion_keys(letters, np.array([len(w) for w in some], np.int64))
            wid = b.column("wid").to_numpy()[at:to]
            yield pa.record_batch([pa.array(wid[number]), pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["wid", "key", "first", "last"])
            at = to


def meetings(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows, ordered by key and place, of the groups in which two words can be near: a whole word and another, or overlapping places."""
    order = np.lexsort((first, key))
    k, f, e = key[order], first[order].astype(np.int64), last[order].astype(np.int64)
    if not len(k):
        return order
    new = np.concatenate(([True], k[1:] != k[:-1]))
    group = np.cumsum(new) - 1
    wide = int(max(e.max(), f.max())) + 3
    reached = np.maximum.accumulate(e + group * wide)
    meets = np.zeros(len(k), bool)
    meets[1:] = ~new[1:] & ((f[1:] + group[1:] * wide <= reached[:-1]) | (f[:-1] < 0))
    near = np.bitwise_or.reduceat(meets, np.flatnonzero(new))
    return order[near[group]]


def _candidates(batches) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket whose keys meet. A bucket holds all rows of its keys and about BUCKET_ROWS rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    rows = meetings(*(t.column(c).to_numpy() for c in ("key", "first", "last")))
    for at in range(0, len(rows), 1 << 16):
        yield from t.take(pa.array(rows[at : at + (1 << 16)])).combine_chunks().to_batches()


def near_in_group(rows: list[tuple[int, str, int, int, int]]) -> Iterator[tuple[int, int, int, str, int]]:
    """Of rows (wid, word, n, first, last) that share a key: wid, near words that it meets here, and of these the most frequent one.

    Strings decide: rows are told apart by what is left after the deletion."""
    by_rest = defaultdict(list)
    for row in rows:
        _, word, _, first, _ = row
        by_rest[word if first < 0 else word[:first] + word[first + 1 :]].append(row)
    for same in by_rest.values():
        whole = [r for r in same if r[3] < 0]
        longer = [r for r in same if r[3] >= 0]
        at = defaultdict(list)
        for r in longer:
            for place in range(r[3], r[4] + 1):
                at[place].append(r)
        for some in ([*at.values()] if len(longer) > 1 else []):
            if len(some) > 1:
                best, second = sorted(some, key=lambda r: (-r[2], r[1]))[:2]
                for r in some:
                    other = second if r is best else best
                    yield r[0], len(some) - 1, other[2], other[1], other[0]
        if whole and longer:
            best = min(longer, key=lambda r: (-r[2], r[1]))
            yield whole[0][0], len(longer), best[2], best[1], best[0]
            for r in longer:
                yield r[0], 1, whole[0][2], whole[0][1], whole[0][0]


_NEAR = "wid long, near long, best_n long, best string, best_wid long"


def _verified(batches) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _NEAR.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def batch(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    key, group, out = None, [], []
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in ("key", "wid", "word", "n", "first", "last"))):
            if k != key:
                out += near_in_group(group) if len(group) > 1 else ()
                key, group = k, []
                if len(out) >= 8192:
                    yield batch(out)
                    out = []
            group.append(tuple(row))
    out += near_in_group(group) if len(group) > 1 else ()
    if out:
        yield batch(out)


def variants(words: DataFrame, times: int = 5, made: list[str] | None = None) -> DataFrame:
    """For a table of distinct words and counts (word, n): word, form, root, n, n_near and form_n.

    n_near counts the words at exactly one inserted, deleted or replaced code point; form is the most frequent of them (ties: the
    smallest) if that is at least `times` as frequent; root is where the forms lead. Words of any length; null words and empty
    words take no part; an empty table gives no rows; further columns are ignored."""
    spark, made = words.sparkSession, [] if made is None else made
    own = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where(F.length("word") > 0)
    words = written(own.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words", made)
    small_batches(spark)
    rows = words.agg(F.sum(F.length("word") + 1).alias("rows")).first()["rows"] or 0
    bits = max(5, (rows // BUCKET_ROWS).bit_length())
    keys = words.select("wid", "word").mapInArrow(_keys, _KEYS)
    met = keys.repartitionById(1 << bits, F.shiftright("key", 62 - bits).cast("int")).mapInArrow(_candidates, _KEYS)
    near = met.join(words, "wid").repartition("key").sortWithinPartitions("key").mapInArrow(_verified, _NEAR)
    # Words and what they meet in one aggregation; the smallest of (-n, word) is the most frequent near word.
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"), F.col("best_wid").alias("wid"))
    both = words.select("wid", "word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,word:string,wid:bigint>").alias("best")).unionByName(
        near.select("wid", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), "near", best.alias("best"))
    )
    found = both.groupBy("wid").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    far = -F.col("best.less") >= times * F.col("n")
    found = written(found.select("wid", "word", "n", "n_near", *(F.when(far, x).alias(a) for x, a in ((F.col("best.word"), "form"), (F.col("best.wid"), "form_wid"), (-F.col("best.less"), "form_n")))), "spelling-near", made)
    # Forms grow by `times` at each step, so chains are short; each round doubles what a word has followed of its chain.
    ways = found.where("form IS NOT NULL").select("wid", F.col("form_wid").alias("root_wid"), F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("wid").alias("root_wid"), F.col("root_wid").alias("then_wid"), F.col("root").alias("then"))
        step = written(ways.join(further, "root_wid", "left"), "spelling-roots", made)
        ways = step.select("wid", F.coalesce("then_wid", "root_wid").alias("root_wid"), F.coalesce("then", "root").alias("root"))
        if not step.where("then IS NOT NULL").limit(1).count():
            break
    out = found.join(ways.select("wid", "root"), "wid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """variants() of the words of all documents (doc_id, text); see word_counts() for what is a word."""
    return variants(word_counts(docs, least_length, least_count), times)
