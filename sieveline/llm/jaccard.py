"""N-gram Jaccard join on a token-group matrix, and components of near copies.

A document is its set of word shingles, as 64-bit hashes. Two documents link when intersection / union reaches a threshold.

1. Equal sets are one class from the start; all that follows is on classes.
2. Similar classes are partitioned into groups: classes of an equal sketch are compared, exactly, with a few of them that
   lead; what links is connected, and a connected part of at most some GROUP_TOKENS tokens is a group. A class that links to
   no leader is a group of its own.
3. The token-group matrix says which groups hold a token. Every total order of tokens gives each set a prefix such that
   linked sets share a token of their prefixes, so the prefixes' rows are enough; frequent tokens come last in the order
   (found per task, the list is bounded), which keeps common passages out. A row that groups of one part only hold is dropped.
4. For two groups the rows that they share, their sizes and places bound the overlap of any query class of the one with any
   class of the other; pairs of groups that can't reach the threshold are not opened.
5. A pair that is open meets with both groups' stored token unions. Each class of the smaller group is a query: its overlap
   with the other's union bounds its similarity to all classes in it, and only where that bound suffices are the classes
   compared, by exact intersection. One link joins two groups, which are connected already.

Groups and bounds only save work: two sets that link are in one group, or their groups are connected by links found.
Tokens are compared by 64-bit hashes: two sets of 10,000 shingles contain an accidental match with a chance of about 5e-12.
Classes are told by a 64-bit digest, which a second one of 64 bits checks; if they disagree the digests are dealt anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_table, bloom, connected_components, drop_paths, filter_bits, hash_words, in_bloom, map_arrow, mix64, release, small_batches, text_buffer, written

#: Bytes of one bucket of prefix tokens, buckets at least, and members of one block of a token's row.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 256
BLOCK_MEMBERS = 1024
#: A token is frequent if this many different sets of one task hold it; at most so many tokens are listed (the order stays right without them).
FREQUENT_SETS = 8
FREQUENT_TOKENS = 1 << 17
#: Counts of a set's tokens by the first bits of their hashes bound overlaps; they go with tokens of at least CROWD groups.
COUNTS, CROWD = 128, 64
#: Sketches of a class, minima of each, and classes that lead those of an equal sketch.
SKETCHES, MINIMA, LEADERS = 8, 4, 4
#: Tokens of a group, unless one class has more.
GROUP_TOKENS = 1 << 16
SALTS = 16

_SEEDS = mix64(np.arange(1, SKETCHES * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(SKETCHES, MINIMA) | np.uint64(1)
LOWER = ascii_lower_table()
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_STEPS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of `width` words; a shorter text is one shingle, a text without words has none."""
    raw, offsets = text_buffer(column)
    words, firsts = hash_words(LOWER[raw], WORD, offsets)
    if not len(words):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total += padded[k : k + len(words)] * _STEPS[k % len(_STEPS)] * np.uint64(2 * (k // len(_STEPS)) + 1)
    shingles = mix64(total)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(shingles[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = np.uint64(b - a)
            for k in range(b - a):
                short = mix64((short + words[a + k : a + k + 1]) * _STEPS[k % len(_STEPS)])[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(tokens: np.ndarray, seed: int = 0) -> int:
    """Hash of a set, as a signed 64-bit number; another seed gives an independent one."""
    n = len(tokens)
    more = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    one, two = (int(mix64(x).sum(dtype=np.uint64)) for x in (tokens + (np.uint64(0x2545F4914F6CDD1D) ^ more), tokens ^ (np.uint64(n) + more)))
    both = (one ^ two * 3) + n & (1 << 64) - 1
    return int(mix64(np.array([both], np.uint64)).view(np.int64)[0])


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b whose Jaccard similarity is at least percent / 100."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Tokens that FREQUENT_SETS different sets of some task hold, rarest first: bounded, and only for the order."""

    def run(batches):
        from collections import Counter

        seen, counts, held, size = set(), Counter(), [], 0

        def flush():
            if held:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                own = n >= 2
                for t, c in zip(tokens[own].tolist(), n[own].tolist(), strict=True):
                    counts[t] += c
                held.clear()
            if len(counts) > 4 * FREQUENT_TOKENS:
                for t, _ in counts.most_common()[: 2 * FREQUENT_TOKENS - 1 : -1]:
                    del counts[t]

        for b in batches:
            for tokens in shingle_sets(b.column(0), width):
                if len(tokens) and (d := set_digest(tokens)) not in seen:
                    seen.add(d)
                    held.append(tokens)
                    size += len(tokens)
            if size > 1 << 19:
                flush()
                size = 0
        flush()
        out = [(t, c) for t, c in counts.most_common(FREQUENT_TOKENS) if c >= FREQUENT_SETS]
        if out:
            yield pa.record_batch([pa.array(np.array([t for t, _ in out], np.uint64).view(np.int64)), pa.array([c for _, c in out], pa.int64())], names=["token", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toArrow()
    table = np.stack([rows.column("token").to_numpy(), rows.column("n").to_numpy()]) if rows.num_rows else np.zeros((2, 0), np.int64)
    return table[:, np.argsort(table[0].view(np.uint64))]


def _ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set's tokens in the global order: by frequency, listed tokens last, then by hash."""
    listed = frequent[0].view(np.uint64)
    if not len(listed) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    n = np.where(listed[at] == tokens, frequent[1][at], 0)
    return tokens[np.argsort(n, kind="stable")] if n.any() else tokens


def _classes(docs: DataFrame, frequent, width: int, percent: int, seed: int) -> DataFrame:
    """doc_id, n, digest and check (null for the empty set), and the prefix, sketches and counts where the task meets the class for the first time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            rows = []
            for tokens in shingle_sets(b.column(1), width):
                if not len(tokens):
                    rows.append((0, None, None, None, None, None))
                    continue
                digest, check = set_digest(tokens, 2 * seed), set_digest(tokens, 2 * seed + 1)
                if digest in seen:
                    rows.append((len(tokens), digest, check, None, None, None))
                else:
                    seen.add(digest)
                    rows.append((len(tokens), digest, check, _ordered(tokens, frequent.value)[: prefix_size(len(tokens), percent)].tobytes(), sketch(tokens), count_vector(tokens)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n", "digest", "check", "prefix", "sketches", "counts"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest long, check long, prefix binary, sketches array<long>, counts binary")


def _shared_tokens(classes: DataFrame, buckets: int, frequent) -> DataFrame:
    """bucket, token, members, sizes, places: prefix tokens that two classes or more share, with these classes.

    Tokens are dealt into buckets in packed form. Those in the list of frequent tokens are dealt by a salt as well, so that no
    bucket gets all classes of a frequent token; such a token has a row for each salt."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def listed(tokens: np.ndarray) -> np.ndarray:
        known = frequent.value[0].view(np.uint64)
        if not len(known):
            return np.zeros(len(tokens), bool)
        return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens

    def deal(batches):
        def out(held):
            tokens, digests, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (tokens >> shift).astype(np.int64)
            hot = listed(tokens)
            bucket[hot] = (mix64(tokens[hot] ^ mix64(digests[hot].view(np.uint64) & np.uint64(SALTS * 4 - 1))) >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            full = [i for i, o in enumerate(own) if len(o)]
            return pa.record_batch([pa.array(full, pa.int32()), *(pa.array([x[own[i]].tobytes() for i in full], pa.binary()) for x in (tokens, digests, sizes, places))], names=["bucket", "tokens", "digests", "sizes", "places"])

        held, size = [], 0
        for b in batches:
            for digest, n, prefix in zip(*b.columns, strict=True):
                tokens = np.frombuffer(prefix.as_py(), np.uint64)
                k = len(tokens)
                held.append((tokens, np.full(k, digest.as_py(), np.int64), np.full(k, n.as_py(), np.int32), np.arange(k, dtype=np.int32)))
                size += k
                if size > 1 << 19:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def join(table: pa.Table) -> pa.Table:
        tokens, digests, sizes, places = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("tokens", np.uint64), ("digests", np.int64), ("sizes", np.int32), ("places", np.int32)))
        order = np.lexsort((digests, tokens))
        t, d = tokens[order], digests[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        order, t = order[new], t[new]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        counts = np.diff(np.append(starts, len(t)))
        kept = (counts > 1) | listed(t[starts])
        order = order[np.repeat(kept, counts)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts[kept])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (digests, sizes, places)]
        n = len(offsets) - 1
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([bucket] * n, pa.int32()), pa.array(t[starts[kept]].view(np.int64)), *lists], names=["bucket", "token", "members", "sizes", "places"])

    small_batches(classes.sparkSession)
    dealt = classes.where("prefix IS NOT NULL").select("digest", "n", "prefix").mapInArrow(deal, "bucket int, tokens binary, digests binary, sizes binary, places binary")
    return dealt.groupBy("bucket").applyInArrow(join, "bucket int, token long, members array<long>, sizes array<int>, places array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """digest, tokens (packed) of the wanted classes (column d), once each, and of a few others that the filter lets pass."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(bloom(wanted.select(F.col("d").alias("h")), filter_bits(wanted.count())))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            digests, sets = [], []
            found = [t for t in shingle_sets(b.column(0), width) if len(t)]
            names = [set_digest(t, 2 * seed) for t in found]
            passing = in_bloom(words.value, np.array(names, np.int64))
            for tokens, d, passes in zip(found, names, passing.tolist(), strict=True):
                if passes and d not in seen:
                    seen.add(d)
                    digests.append(d)
                    sets.append(tokens.tobytes())
            if digests:
                yield pa.record_batch([pa.array(digests, pa.int64()), pa.array(sets, pa.binary())], names=["digest", "tokens"])

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "digest long, tokens binary").dropDuplicates(["digest"])


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int, seed: int, made: list[str]) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, by exact intersection."""
    wanted = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, wanted, width, seed), "jaccard-sets", made)
    release(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        a, b, kept = batch.column(0), batch.column(1), []
        last_key, last = None, None
        for key, x, y in zip(a.to_pylist(), batch.column(2), batch.column(3), strict=True):
            if key != last_key:
                last_key, last = key, np.frombuffer(x.as_py(), np.uint64)
            other = np.frombuffer(y.as_py(), np.uint64)
            n = common_tokens(last, other)
            kept.append(100 * n >= percent * (len(last) + len(other) - n))
        yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(kept))

    left = sets.select(F.col("digest").alias("b"), F.col("tokens").alias("tokens_b"))
    right = sets.select(F.col("digest").alias("a"), F.col("tokens").alias("tokens_a"))
    joined = pairs.select("a", "b").join(left, "b").select("a", "b", "tokens_b").join(right, "a").select("a", "b", "tokens_a", "tokens_b")
    return map_arrow(joined, run, "a long, b long")


def common_tokens(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _members(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """d, n, comp, g: the classes of connected parts, each part dealt into groups of about GROUP_TOKENS tokens; a group goes by its smallest class."""
    sizes = classes.where("prefix IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.first("n").alias("n"))
    own = parts.select(F.col("v").alias("d"), "comp").join(sizes, "d")
    groups = own.groupBy("comp").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("groups"))
    dealt = own.join(groups, "comp").withColumn("block", F.pmod(F.xxhash64("d"), F.col("groups")).cast("int"))
    named = dealt.groupBy("comp", "block").agg(F.min("d").alias("g"))
    return dealt.join(named, ["comp", "block"]).select("d", "n", "comp", "g")


def _group_matrix(shared: DataFrame, members: DataFrame) -> DataFrame:
    """token, g, comp, lo, hi (sizes of the group's classes with the token), p (place in a class that is alone, else 0), alone: the rows that groups of different parts hold, and k, the groups of the row."""
    spread = shared.select("token", F.explode(F.arrays_zip("members", "sizes", "places")).alias("e")).select("token", F.col("e.members").alias("d"), F.col("e.sizes").alias("n"), F.col("e.places").alias("p"))
    named = spread.join(members.select("d", "comp", "g"), "d", "left")
    named = named.select("token", F.coalesce("g", "d").alias("g"), F.coalesce("comp", "d").alias("comp"), "n", F.when(F.col("g").isNull(), F.col("p")).otherwise(0).alias("p"), F.col("g").isNull().alias("alone"))
    held = named.groupBy("token", "g").agg(F.first("comp").alias("comp"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("p").alias("p"), F.first("alone").alias("alone"))
    open_tokens = held.groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.count("*").alias("k")).where("one <> other").select("token", "k")
    return held.join(open_tokens, "token")


def _candidates(matrix: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of groups of different parts that may hold a link, as far as the rows that they share, sizes and places tell."""
    # a class can share no more prefix tokens than its group has rows, and before a token no more than precede it there
    own_rows = Window.partitionBy("g")
    rows = matrix.withColumn("s", F.count("*").over(own_rows)).withColumn("q", F.row_number().over(own_rows.orderBy("p")) - 1)
    rows = rows.withColumn("q", F.when(F.col("alone"), F.col("q")).otherwise(F.col("s") - 1))
    vectors = classes.where("counts IS NOT NULL").groupBy(F.col("digest").alias("g")).agg(F.first("counts").alias("v"))
    rows = rows.join(vectors, "g", "left").withColumn("v", F.when(F.col("alone") & (F.col("k") >= CROWD), F.col("v")))
    # rows of a long list are dealt into pairs of blocks, so that no task gets an unbounded list
    blocks = F.ceil(F.col("k") / BLOCK_MEMBERS).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("g"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    fields = ["g", "comp", "lo", "hi", "p", "alone", "own", "s", "q"]
    grouped = rows.groupBy("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct(*fields, "v")).alias("m"))

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in np.concatenate(found, 1)], names=["a", "b", "left", "rest", "need"])

    def run(batch: pa.RecordBatch):
        found, size = [], 0
        for i, j, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            e = entries.values
            g, comp, lo, hi, p, alone, own, s, q = (e.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields)))
            rest = -(-percent * hi // 100) - 1
            left = np.where(alone > 0, lo - p - 1, hi - 1)
            least = -(-percent * lo // 100)
            v = e.field(len(fields))
            known, vectors = ~np.asarray(v.is_null()), None
            if known.any():
                vectors = np.zeros((len(g), COUNTS), np.uint8)
                vectors[known] = np.frombuffer(b"".join(v.drop_null().to_pylist()), np.uint8).reshape(-1, COUNTS)
            x, y = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(g)),) * 2
            for at in range(0, len(x), 512):
                r = x[at : at + 512, None]
                # the smallest sizes of classes that can link
                need = least_overlap(np.maximum(lo[r], least[y]), np.maximum(lo[y], least[r]), percent)
                fits = (comp[r] != comp[y]) & (hi[y] >= least[r]) & (hi[r] >= least[y]) & (np.minimum(s[r], s[y]) + np.maximum(rest[r], rest[y]) >= need)
                # tokens that are shared before this one are in open rows of both, those behind it come after it in both
                fits &= np.minimum(q[r], q[y]) + 1 + np.minimum(left[r], left[y]) >= need
                if i == j:
                    fits &= g[r] < g[y]
                a, b = np.nonzero(fits)
                needs = need[a, b]
                a, b = x[at + a], y[b]
                if vectors is not None and len(a):
                    # no more tokens are shared than the smaller count of each range
                    both = np.concatenate([np.minimum(vectors[a[n : n + 65536]], vectors[b[n : n + 65536]]).sum(1, dtype=np.int64) for n in range(0, len(a), 65536)])
                    fine = (both >= needs) | ~known[a] | ~known[b]
                    a, b, needs = a[fine], b[fine], needs[fine]
                # a class alone is the query of a group of several
                swap = (alone[a] > alone[b]) | ((alone[a] == alone[b]) & (g[a] > g[b]))
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                both_alone = (alone[a] > 0) & (alone[b] > 0)
                found.append(np.stack([g[a], g[b], np.where(both_alone, np.minimum(left[a], left[b]), np.iinfo(np.int32).max), np.maximum(rest[a], rest[b]), needs]))
                size += len(a)
                if size > 1 << 17:
                    yield packed(found)
                    found, size = [], 0
        if size:
            yield packed(found)

    pairs = map_arrow(grouped.select("i", "j", "m"), run, "a long, b long, left long, rest long, need long")
    # What two sets share beyond the last token that they share in their prefixes comes after it in both (for classes that are
    # alone that token is known), and what they share beyond the shorter reaching prefix is in that set's rest.
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("left").alias("left"), F.max("rest").alias("rest"), F.min("need").alias("need"))
    return counted.where(F.col("c") + F.least("left", "rest") >= F.col("need")).select("a", "b")


def packed_group(digests: list[int], sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes, bytes | None]:
    """A group as digests, sizes, token union and the places of each class's tokens in the union (none for one class)."""
    sizes = np.array([len(s) for s in sets], np.int32)
    if len(sets) == 1:
        return np.array(digests, np.int64).tobytes(), sizes.tobytes(), sets[0].tobytes(), None
    union, places = np.unique(np.concatenate(sets), return_inverse=True)
    return np.array(digests, np.int64).tobytes(), sizes.tobytes(), union.tobytes(), places.astype(np.int32).tobytes()


class Group:
    """A packed group, to be opened for queries."""

    def __init__(self, digests: bytes, sizes: bytes, union: bytes, places: bytes | None, percent: int):
        self.digests, self.sizes = np.frombuffer(digests, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.union, self.percent = np.frombuffer(union, np.uint64), percent
        self.places = np.frombuffer(places, np.int32) if places is not None else np.arange(len(self.union))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.least = -(-percent * int(self.sizes.min()) // 100)
        self.most = int(self.sizes.max())

    def sets(self):
        """(digest, tokens) of the classes."""
        for digest, at, n in zip(self.digests.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield digest, self.union[np.sort(self.places[at : at + n])]

    def link(self, query: np.ndarray) -> int | None:
        """The digest of a class that links with the query's tokens (sorted), if there is one."""
        n = len(query)
        if n < self.least or self.most < -(-self.percent * n // 100):
            return None
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        found = self.union[at] == query
        bound = int(found.sum())
        # no class holds more of the query's tokens than the union does
        if bound < least_overlap(n, max(int(self.sizes.min()), -(-self.percent * n // 100)), self.percent):
            return None
        own = np.zeros(len(self.union), bool)
        own[at[found]] = True
        shared = np.add.reduceat(own[self.places], self.starts, dtype=np.int64)
        hits = np.flatnonzero(100 * shared >= self.percent * (self.sizes + n - shared))
        return int(self.digests[hits[0]]) if len(hits) else None


def _opened(docs: DataFrame, pairs: DataFrame, members: DataFrame, width: int, percent: int, seed: int, made: list[str]) -> DataFrame:
    """a, b: a link for each pair of groups that holds one."""
    named = pairs.select(F.col("a").alias("g")).union(pairs.select("b")).distinct()
    wanted = written(named.join(members.select("g", "d"), "g", "left").select("g", F.coalesce("d", "g").alias("d"), F.col("d").isNull().alias("alone")), "jaccard-wanted", made)
    sets = written(_sets(docs, wanted.select("d"), width, seed).withColumnRenamed("digest", "d").join(wanted, "d"), "jaccard-sets", made)
    release(docs.sparkSession)
    shape = "g long, digests binary, sizes binary, tokens binary, places binary"

    def single(batch: pa.RecordBatch):
        rows = [(g, *packed_group([d], [np.frombuffer(t.as_py(), np.uint64)])) for g, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
        yield _group_rows(rows)

    def several(batch: pa.RecordBatch):
        for g, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = held.as_py()
            yield _group_rows([(g, *packed_group([h["d"] for h in held], [np.frombuffer(h["tokens"], np.uint64) for h in held]))])

    groups = map_arrow(sets.where("alone").select("g", "d", "tokens"), single, shape)
    groups = groups.unionByName(map_arrow(sets.where("NOT alone").groupBy("g").agg(F.collect_list(F.struct("d", "tokens")).alias("m")), several, shape))
    groups = written(groups, "jaccard-groups", made)
    release(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        found, last_key, last = [], None, None
        for key, *fields in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if key != last_key:
                last_key, last = key, Group(*(f.as_py() for f in fields[:4]), percent)
            for digest, tokens in Group(*(f.as_py() for f in fields[4:]), percent).sets():
                other = last.link(tokens)
                if other is not None:
                    found.append((other, digest))
                    break
        yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    payload = ("digests", "sizes", "tokens", "places")
    side = lambda x: groups.select(F.col("g").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in payload))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return map_arrow(joined.select("a", *(f"{c}_a" for c in payload), *(f"{c}_b" for c in payload)), run, "a long, b long")


def _group_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "digests", "sizes", "tokens", "places"])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of a set, each of MINIMA minima of hash functions: equal for similar sets with a fair chance."""
    least = np.array([(tokens * seed).min() for seed in _SEEDS.ravel()], np.uint64).reshape(_SEEDS.shape)
    return mix64((mix64(least) * _SEEDS).sum(1, dtype=np.uint64)).view(np.int64)


def count_vector(tokens: np.ndarray) -> bytes | None:
    """Tokens in each of COUNTS ranges of hashes, a byte each; none for sets too large for bytes."""
    counts = np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=COUNTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _sketch_stars(classes: DataFrame) -> DataFrame:
    """Pairs (leader, class) of classes with an equal sketch.

    These pairs are compared exactly like all others; they connect a crowd with a few comparisons for each class instead of
    all pairs."""
    own = classes.where("prefix IS NOT NULL").select("digest", "sketches")
    sketched = own.select(F.explode("sketches").alias("k"), F.col("digest").alias("b")).distinct()
    # leaders are the first of several orders; an aggregate of fixed size, however large the crowd
    some = F.array_distinct(F.array(*[F.min_by("b", F.xxhash64(F.lit(i), "b")) for i in range(LEADERS)]))
    leaders = sketched.groupBy("k").agg(some.alias("some"), F.min("b").alias("y"), F.max("b").alias("z")).where("y <> z").select("k", F.explode("some").alias("a"))
    return sketched.join(leaders, "k").where("a <> b").select("a", "b").distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links, itself included), digest (class of the set).

    Null, empty and blank texts have no shingles and link with nothing: their component is their own key. Repeated rows and
    keys are rows of their own, all with a result. Null keys get the smallest key of their component, null if it has none.
    Very long texts are taken whole, an empty table gives no row, and other columns of docs don't matter.
    The result is written, so it can be read twice."""
    return _near_copies(docs, text, key, width, percent)[0]


def _near_copies(docs: DataFrame, text: str, key: str, width: int, percent: int) -> tuple[DataFrame, int]:
    """The result of near_copies() and the seed of its digests."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    made: list[str] = []
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))
    seed = 0
    while True:
        classes = written(_classes(docs, frequent, width, percent, seed), "jaccard-classes", made)
        told = classes.where("digest IS NOT NULL").groupBy("digest").agg(F.min("check").alias("one"), F.max("check").alias("other"))
        if not told.where("one <> other").limit(1).count():
            break
        seed += 1

    stars = written(_sketch_stars(classes), "jaccard-stars", made)
    links = written(_linked(docs, stars, width, percent, seed, made), "jaccard-links", made)
    release(spark)
    parts = connected_components(links, what="jaccard-parts", made=made)
    members = written(_members(classes, parts), "jaccard-members", made)

    total = classes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_BYTES < 3 * total:
        buckets *= 2
    shared = written(_shared_tokens(classes, buckets, frequent), "jaccard-tokens", made)
    release(spark)
    matrix = written(_group_matrix(shared, members), "jaccard-matrix", made)
    release(spark)
    pairs = written(_candidates(matrix, classes, percent), "jaccard-pairs", made)
    release(spark)
    components = parts
    if pairs.limit(1).count():
        more = written(_opened(docs, pairs, members, width, percent, seed, made), "jaccard-links", made)
        release(spark)
        components = connected_components(links.unionByName(more), what="jaccard-components", made=made)

    # the smallest key of each component; keys are (class, salt), so that no class meets in one task
    rows = classes.select("doc_id", "n", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    dealt = rows.where("digest IS NOT NULL").groupBy("digest", "salt").agg(F.min("doc_id").alias("m"))
    labelled = dealt.join(components.select(F.col("v").alias("digest"), "comp"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    first = written(labelled.groupBy("comp").agg(F.min("m").alias("component_id")), "jaccard-first", made)
    named = labelled.join(first, "comp").select("digest", "salt", "component_id")
    whole = rows.where("digest IS NOT NULL").join(named, ["digest", "salt"]).select("doc_id", "n", "component_id", "digest")
    out = whole.unionByName(rows.where("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"), "digest"))
    result = written(out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", "digest"), "jaccard-result")
    drop_paths(spark, made)
    return result, seed


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, but of each component of near copies only the row with the smallest key (one of them, if rows repeat it).

    Rows without shingles (null, empty and blank texts) all stay; rows with a null key leave where a component has a row with
    a key. An empty table stays empty. Columns may have any names."""
    names = docs.columns
    # columns by number inside, so that no name clashes with one of ours
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, at = f"c{names.index(key)}", names.index(text)
    found, seed = _near_copies(docs, f"c{at}", own, width, percent)
    found = found.where("digest IS NOT NULL").withColumnRenamed(own, "k")
    least = found.groupBy("component_id").agg(F.min(F.struct("k", "digest")).alias("first"), F.count("*").alias("n"))
    # a component of null keys only has no id to tell it by: its rows stay
    many = written(least.where("n > 1 AND component_id IS NOT NULL").select("component_id", F.col("first.digest").alias("kept")), "jaccard-many")
    crowded = found.join(many, "component_id")
    gone = crowded.where(~(F.col("k").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("kept")))).select("k", "digest").distinct()
    repeats = crowded.where((F.col("k") == F.col("component_id")) & (F.col("digest") == F.col("kept"))).groupBy("k", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("again_k"), F.col("digest").alias("again_digest"))
    twice = bool(repeats.limit(1).count())

    def run(batch: pa.RecordBatch):
        digests = [set_digest(t, 2 * seed) if len(t) else None for t in shingle_sets(batch.column(at), width)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.int64())], names=[*batch.schema.names, "digest"])

    from pyspark.sql.types import LongType, StructType

    with_digest = map_arrow(docs, run, StructType([*docs.schema.fields]).add("digest", LongType()))
    kept = with_digest.join(gone.select(F.col("k").alias("gone_k"), F.col("digest").alias("gone_digest")), F.col(own).eqNullSafe(F.col("gone_k")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    if twice:
        one = Window.partitionBy(own, "digest").orderBy(F.lit(0))
        tagged = kept.join(repeats, (F.col(own) == F.col("again_k")) & (F.col("digest") == F.col("again_digest")), "left")
        single = tagged.where("again_k IS NULL").select(*kept.columns)
        kept = single.unionByName(tagged.where("again_k IS NOT NULL").withColumn("r", F.row_number().over(one)).where("r = 1").select(*kept.columns))
    return kept.select(*docs.columns).toDF(*names)
