"""Benchmark decontamination: each shard of training text gets a suffix array over its words, in which every suffix of the
test items is looked up by binary search.

A shard is a run of documents of a partition, so nothing is shuffled; memory is bounded by `SHARD_WORDS` or one document.
The test items are broadcast in blocks of a checked size, one pass over the documents for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_table, drop_paths, hash_words, map_arrow, text_buffer, written

#: Words of a shard, unless one document has more.
SHARD_WORDS = 1 << 20
#: Bytes of test text in a broadcast.
BLOCK_BYTES = 8 << 20
#: Blocks that one pass over the documents takes.
PASS_BLOCKS = 4
PLACES = "array<struct<item:string,item_word:int,word:int,length:int>>"


def word_bytes() -> np.ndarray:
    """Digits, lower-case letters and what isn't ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


LOWER, WORD = ascii_lower_table(), word_bytes()


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffer(column)
    return hash_words(LOWER[raw], WORD, offsets)


class Shard:
    """Suffix array over the words of some texts; suffixes are in order by their first `depth` words."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray, depth: int):
        sizes = np.diff(firsts)
        texts = len(sizes)
        # a separator that no test word equals ends each text
        place = np.arange(len(words)) + np.repeat(np.arange(texts), sizes)
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        self.ranks = np.zeros(len(words) + texts + depth, np.int64)
        self.ranks[place] = ranks + 1
        self.text_at = firsts[:-1] + np.arange(texts)
        self.size = len(words) + texts
        order, span, key = None, 1, self.ranks[: self.size]
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(self.size, np.int64)
            steps = np.empty(self.size, np.int64)
            steps[0] = 0
            np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
            new[order] = steps
            if span >= depth or steps[-1] == self.size - 1:
                break
            ahead = np.zeros(self.size, np.int64)
            ahead[: max(self.size - span, 0)] = new[span:] + 1
            key, span = new * (self.size + 2) + ahead, span * 2
        self.order = order

    def rank_of(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words in this shard, 0 for those that it lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def lower_bound(self, queries: np.ndarray) -> np.ndarray:
        """Binary search: for each row of ranks, how many suffixes are smaller."""
        n, width = queries.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        steps = np.arange(width)
        rows = np.arange(n)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            suffix = self.ranks[self.order[mid][:, None] + steps]
            differs = suffix != queries[open_]
            first = differs.argmax(1)
            at = rows[: len(open_)]
            smaller = differs[at, first] & (suffix[at, first] < queries[open_][at, first])
            low[open_[smaller]] = mid[smaller] + 1
            high[open_[~smaller]] = mid[~smaller]
        return low

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places where a row of queries occurs verbatim: (row, place)."""
        above = queries.copy()
        above[:, -1] += 1
        low, high = np.split(self.lower_bound(np.concatenate([queries, above])), 2)
        counts = high - low
        rows = np.repeat(np.arange(len(queries)), counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rows, self.order[low[rows] + within]


class Items:
    """Windows of the test items: words of each item end to end; a window starts at each place that has `width` words left, or at the only one of a shorter item."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        self.width = width
        words, firsts = words_of(pa.array(texts, pa.large_string()))
        sizes = np.diff(firsts)
        self.words = np.concatenate([words, np.zeros(width, np.uint64)])
        n_windows = np.where(sizes == 0, 0, np.maximum(sizes - width + 1, 1))
        item = np.repeat(np.arange(len(sizes)), n_windows)
        start = np.repeat(firsts[:-1], n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        length = np.minimum(sizes[item], width)
        self.left = firsts[1:][item] - start  # words up to the item's end
        self.start, self.length, self.item = start, length, item
        self.at = start - firsts[:-1][item]  # place in the item
        self.ids = ids

    def maximal(self, window: np.ndarray, place: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Which occurrences begin a longest verbatim match: those that no occurrence of the item's window one word before goes on."""
        start, item = self.start[window], self.item[window]
        order = np.lexsort((start, place - start, item))
        first = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        first[1:] = (item[a] != item[b]) | (place[a] - start[a] != place[b] - start[b]) | (start[a] + 1 != start[b])
        return order[first]

    def search(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all windows in a shard: (window, place in the shard, length of the longest match from there)."""
        found_w, found_p = [], []
        ranks = shard.rank_of(self.words)
        for m in np.unique(self.length):
            own = np.flatnonzero(self.length == m)
            rows = ranks[self.start[own][:, None] + np.arange(m)]
            known = (rows > 0).all(1)
            own, rows = own[known], rows[known]
            if not len(own):
                continue
            # items can share windows: each distinct one is searched once
            distinct, back = np.unique(rows, axis=0, return_inverse=True)
            w, p = shard.find(distinct)
            if not len(w):
                continue
            back = back.ravel()
            by = np.argsort(back, kind="stable")
            counts = np.bincount(back, minlength=len(distinct))
            firsts = np.cumsum(counts) - counts
            again = counts[w]
            within = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            found_w.append(own[by[np.repeat(firsts[w], again) + within]])
            found_p.append(np.repeat(p, again))
        if not found_w:
            none = np.zeros(0, np.int64)
            return none, none, none
        window, place = np.concatenate(found_w), np.concatenate(found_p)
        longest = self.length[window].copy()
        left = self.left[window]
        padded = np.concatenate([shard.ranks, np.zeros(1, np.int64)])
        going = np.flatnonzero(longest < left)
        while len(going):
            here = padded[np.minimum(place[going] + longest[going], len(padded) - 1)]
            same = (here > 0) & (here == ranks[self.start[window[going]] + longest[going]])
            longest[going[same]] += 1
            going = going[same]
            going = going[longest[going] < left[going]]
        return window, place, longest


def matches(blocks: list[Callable[[], Items]], width: int, texts: pa.Array) -> Iterator[tuple[int, int, int, list, np.ndarray, list[dict]]]:
    """For each text: its words, words in an occurrence of a window, longest match, ids of items with such, the hit mask, and the longest verbatim matches with their places. A shard's suffix array is built once for all blocks of items."""
    words, firsts = words_of(texts)
    depth = 1
    while depth < width:
        depth *= 2
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(firsts, firsts[at] + SHARD_WORDS, "right")) - 1)
        shard = Shard(words[firsts[at] : firsts[upto]], firsts[at : upto + 1] - firsts[at], depth)
        marks, best = np.zeros(shard.size + 1, np.int64), np.zeros(upto - at, np.int64)
        names: dict[int, list] = {}
        found: dict[int, list[dict]] = {}
        for block in blocks:
            items = block()
            window, place, longest = items.search(shard)
            np.add.at(marks, place, 1)
            np.add.at(marks, place + items.length[window], -1)
            text = np.searchsorted(shard.text_at, place, "right") - 1
            np.maximum.at(best, text, longest)
            for pair in np.unique(text * len(items.ids) + items.item[window]).tolist() if len(window) else ():
                names.setdefault(pair // len(items.ids), []).append(items.ids[pair % len(items.ids)])
            for w in items.maximal(window, place, longest).tolist():
                k = int(text[w])
                found.setdefault(k, []).append({"item": items.ids[items.item[window[w]]], "item_word": int(items.at[window[w]]), "word": int(place[w] - shard.text_at[k]), "length": int(longest[w])})
        hit = np.cumsum(marks[:-1]) > 0
        for k in range(upto - at):
            n = int(firsts[at + k + 1] - firsts[at + k])
            own = hit[shard.text_at[k] : shard.text_at[k] + n]
            yield n, int(own.sum()), int(best[k]), names.get(k, []), own, found.get(k, [])
        at = upto


def item_blocks(benchmark: DataFrame, text: str, item_id: str, block_bytes: int):
    """The test items in blocks of at most block_bytes of text (or one item), each read from the cluster on its own."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        n = len((row.text or "").encode())
        if ids and size + n > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += n
    if ids:
        yield ids, texts


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", width: int = 10, item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES, locations: bool = False) -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside an occurrence of a window of `width` item words), items (ids with such windows, sorted as strings), longest (longest verbatim match in words), contaminated; with locations also matches: the longest verbatim matches (item, item_word, word, length; places count words from 0), in order of word, item and item_word.

    The test items go round in blocks of block_bytes; a pass over the documents takes PASS_BLOCKS of them, and what it has found is written before the
    next one begins. Texts of any length are searched whole, in shards; an empty table of documents gives no rows, one of items no matches. A document or item that is null or has no words matches nothing; an item of fewer words is one window. Items with a
    null id contaminate, but aren't listed. Repeated rows and ids are each judged on their own; other columns of docs don't matter."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("mask"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"), F.array().cast(PLACES).alias("matches"))
    schema = f"key {kind}, text string, mask binary, items array<string>, longest long, matches {PLACES}"
    place_kind = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("length", pa.int32())]))

    def passed(frame: DataFrame, shared: list, last: bool) -> DataFrame:
        def run(batch: pa.RecordBatch):
            blocks = [lambda b=b: b.value for b in shared]
            masks, names, longest, words, hits, places = [], [], [], [], [], []
            texts = batch.column(1)
            for (n, _, best, found, own, here), mask, before, most, there in zip(matches(blocks, width, texts), *batch.columns[2:], strict=True):
                if mask.is_valid:
                    own = own | np.unpackbits(np.frombuffer(mask.as_py(), np.uint8), count=n).astype(bool)
                masks.append(np.packbits(own).tobytes() if own.any() else None)
                names.append(sorted({*before.as_py(), *(x for x in found if x is not None)}))
                longest.append(max(best, most.as_py()))
                words.append(n)
                hits.append(int(own.sum()))
                places.append(sorted([*there.as_py(), *here], key=lambda m: (m["word"], m["item"] is not None, m["item"] or "", m["item_word"])) if locations else [])
            lists = pa.array(names, pa.list_(pa.string()))
            if last:
                yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), lists, pa.array(longest, pa.int64()), pa.array([h > 0 for h in hits]), pa.array(places, place_kind)], names=["key", "n_words", "n_hit", "items", "longest", "contaminated", "matches"])
            else:
                yield pa.record_batch([batch.column(0), texts, pa.array(masks, pa.binary()), lists, pa.array(longest, pa.int64()), pa.array(places, place_kind)], names=["key", "text", "mask", "items", "longest", "matches"])

        return map_arrow(frame, run, f"key {kind}, n_words long, n_hit long, items array<string>, longest long, contaminated boolean, matches {PLACES}" if last else schema)

    passes = shared_passes(benchmark, item_text, item_id, block_bytes, width)
    shared, made = next(passes, []), []
    while True:
        following = next(passes, None)
        if following is None:
            return passed(state, shared, True).withColumnRenamed("key", key).drop(*[] if locations else ["matches"])
        before, made = made, []
        state = written(passed(state, shared, False), "decontaminate", made)
        drop_paths(spark, before)
        shared = following


def shared_passes(benchmark: DataFrame, text: str, item_id: str, block_bytes: int, width: int) -> Iterator[list]:
    """Broadcast blocks of items, PASS_BLOCKS at a time."""
    spark, held = benchmark.sparkSession, []
    for block in item_blocks(benchmark, text, item_id, block_bytes):
        held.append(spark.sparkContext.broadcast(Items(*block, width)))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of any test item. Nulls, repeats and short items as in annotate()."""
    at, made = docs.columns.index(text), []
    for number, shared in enumerate(shared_passes(benchmark, item_text, item_id, block_bytes, width)):
        if number:
            before, made = made, []
            docs = written(docs, "decontaminate", made)
            drop_paths(docs.sparkSession, before)

        def run(batch: pa.RecordBatch, shared=shared):
            blocks = [lambda b=b: b.value for b in shared]
            yield batch.filter(pa.array([not hits for _, hits, *_ in matches(blocks, width, batch.column(at))], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def digest(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report of annotate() with the list of items as its number and hash."""
    return report.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest")


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
