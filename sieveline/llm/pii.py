"""Personal data: fixed patterns give seeds, the words before them give lexical patterns, and sure ones find identifiers of other forms.

The bootstrapping works on a graph of patterns and instances. A pattern is the one, two or three words before an identifier on its
line; an instance is a value of a kind. Instances of the fixed kinds are sure. A pattern's confidence is the share of all its
occurrences in the corpus that precede an instance of the kind, weighted by the instances' confidence; it counts only with
`least_values` different confident instances, so copies prove nothing. An instance is as sure as its best pattern. Spark repeats
this in rounds: a found identifier makes patterns of its own wherever else it stands. What is shuffled are identifiers and counts
of words before them, never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, filter_bits, hash_places, in_bloom, map_arrow, mix64, small_batches, text_buffer, word_places, written

#: The kinds in their order, and their patterns (linear forms of the stated ones; see base_spans).
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = bytes(x for x in range(256) if not 48 <= x <= 57)

#: What a found identifier may look like: digits with separators; user@host and written-out forms; groups with colons.
_LOOSE = re.compile(rb"[0-9](?:[().\x20/-]{0,3}[0-9])+")
_AT = re.compile(rb"@|[\x20]?[\[(]at[\])][\x20]?", re.I)
_HOST = re.compile(rb"[A-Za-z0-9-]+(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?)[A-Za-z0-9-]+)*", re.I)
_COLONS = re.compile(rb":[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4})+")

LOCAL, WORD, HEX = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
for _table, _bytes in ((LOCAL, b"._%+-"), (WORD, bytes(range(128, 256))), (HEX, b"abcdefABCDEF")):
    _table[list(_bytes) + list(range(48, 58))] = True
    if _table is not HEX:
        _table[list(range(65, 91)) + list(range(97, 123))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def luhn(digits: bytes) -> bool:
    odd = sum(d - 48 for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * (d - 48), 10)) for d in digits[-2::-2])) % 10 == 0


def _left(buf: bytes, table: np.ndarray, at: int, least: int) -> int:
    """Where the run of the table's bytes that ends at `at` begins."""
    while at > least and table[buf[at - 1]]:
        at -= 1
    return at


def base_spans(buf: bytes, begin: int, end: int, ats: list[int], digits: tuple[int, int] | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed kinds in buf[begin:end], in bytes, each kind leftmost and without overlaps, in linear time.

    ats: places of `@` in the text; digits: places of its first and last digit. An email is read from its `@`: the local part
    reaches left as far as it can, no further than the email before. An address is each four of the longest dotted numbers."""
    out, last = [], begin
    for at in ats:
        if at < last:
            continue
        start = _left(buf, LOCAL, at, last)
        if start < at and (m := _DOMAIN.match(buf, at + 1, end)):
            out.append((start, m.end(), EMAIL))
            last = m.end()
        else:
            last = at + 1
    if digits:
        first, stop = digits[0], digits[1] + 1
        for m in _NUMBERS.finditer(buf, first, stop):
            parts = m[0].split(b".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in parts[k : k + 4]):
                    out.append((at, at + size, IP))
                at += size + 1
        for m in _DIGITS.finditer(buf, first, stop):
            number = m[0].translate(None, _NO_DIGIT)
            if 14 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), m.end(), CARD))
        for m in _PHONE.finditer(buf, max(begin, first - 1), stop):
            if 10 <= len(m[0].translate(None, _NO_DIGIT)) <= 15:
                out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def loose_spans(buf: bytes, begin: int, end: int, digits: tuple[int, int] | None, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of what may be an identifier of another form, clear of the spans taken and of each other."""
    found = []
    if digits:
        for m in _LOOSE.finditer(buf, digits[0], digits[1] + 1):
            n = len(m[0].translate(None, _NO_DIGIT))
            kinds = (7 <= n <= 15) << PHONE | (12 <= n <= 19) << CARD
            if kinds:
                found.append((m.start(), m.end(), kinds))
    last = begin
    for m in _AT.finditer(buf, begin, end):
        start = _left(buf, LOCAL, m.start(), last)
        if start < m.start() and (host := _HOST.match(buf, m.end(), end)):
            found.append((start, host.end(), 1 << EMAIL))
            last = host.end()
    last = begin
    for m in _COLONS.finditer(buf, begin, end):
        start = _left(buf, HEX, m.start(), last)
        if m.start() - start <= 4 and sum(map(HEX.__getitem__, buf[start : m.end()])) >= 3:
            found.append((start, m.end(), 1 << IP))
        last = m.end()
    out, reach, k = [], begin, 0
    taken = sorted(taken)
    for start, stop, kinds in sorted(found):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        whole = (start == begin or not WORD[buf[start - 1]]) and (stop == end or not WORD[buf[stop]])
        if start >= reach and whole and not any(t[0] < stop and t[1] > start for t in taken[k : k + 8]):
            out.append((start, stop, kinds))
            reach = stop
    return out


def _contexts(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each word, the patterns of one, two and three words that end with it (0: the line is shorter). A line's start is told apart."""
    one = mix64(hashes ^ np.uint64(1))
    before, back = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:] = np.where(line[1:] == line[:-1], hashes[:-1], np.uint64(0))
    back[2:] = np.where(line[2:] == line[:-2], hashes[:-2], np.uint64(0))
    two = mix64(one ^ mix64(before ^ np.uint64(2)))
    three = np.where(before != 0, mix64(two ^ mix64(back ^ np.uint64(3))), np.uint64(0))
    return np.stack((one, two, three)).view(np.int64)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the words (letters, digits, bytes beyond ASCII), their patterns and lines, and where lines begin: at a newline or a text's start."""
    lower = _LOWER[raw]
    start, end, _ = word_places(lower, WORD, offsets)
    breaks = np.sort(np.concatenate((np.flatnonzero(raw == 10), offsets)))
    line = np.searchsorted(breaks, start, "right")
    return end, _contexts(hash_places(lower, start, end), line), line, breaks


_SCAN = "rid long, doc_id long, base array<struct<start:long,kind:int,end:long>>, mentions array<struct<start:long,end:long,kind:int,kinds:int,value:long,patterns:array<long>>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_MENTION = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("kinds", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """Spans of the fixed kinds and mentions (also those of other forms) of each text, with places in code points."""
    from pyspark import TaskContext

    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 40
    for b in batches:
        raw, offsets = text_buffer(b.column("text"))
        buf = raw.tobytes()
        ats, digits = np.flatnonzero(raw == 64), np.flatnonzero((raw >= 48) & (raw <= 57))
        at_of, digit_of = np.searchsorted(ats, offsets), np.searchsorted(digits, offsets)
        bases, mentions = [], []
        words = None
        for i in range(b.num_rows):
            begin, end = int(offsets[i]), int(offsets[i + 1])
            some = (int(digits[digit_of[i]]), int(digits[digit_of[i + 1] - 1])) if digit_of[i] < digit_of[i + 1] else None
            base = base_spans(buf, begin, end, ats[at_of[i] : at_of[i + 1]].tolist(), some)
            loose = loose_spans(buf, begin, end, some, base)
            if not base and not loose:
                bases.append([])
                mentions.append([])
                continue
            words = words or _words(raw, offsets)
            ends, patterns, line, breaks = words
            points = np.cumsum((raw[begin:end] & 0xC0) != 0x80)
            place = lambda x: int(points[x - begin - 1]) if x > begin else 0
            bases.append([{"start": place(s), "kind": k, "end": place(e)} for s, e, k in base])
            own = []
            for s, e, kind, kinds in [(s, e, k, 0) for s, e, k in base] + [(s, e, None, k) for s, e, k in loose]:
                word = int(np.searchsorted(ends, s, "right")) - 1
                same_line = word >= 0 and line[word] == int(np.searchsorted(breaks, s, "right"))
                value = hashlib.blake2b(bytes(c for c in buf[s:e].lower() if WORD[c]), digest_size=8).digest()
                own.append({"start": place(s), "end": place(e), "kind": kind, "kinds": kinds, "value": int.from_bytes(value, "little", signed=True), "patterns": [p for p in patterns[:, word].tolist() if p] if same_line else []})
            mentions.append(own)
        rid = np.arange(row, row + b.num_rows)
        row += b.num_rows
        yield pa.record_batch([pa.array(rid), b.column("doc_id"), pa.array(bases, _SPAN), pa.array(mentions, _MENTION)], ["rid", "doc_id", "base", "mentions"])


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each pattern of `wanted` (pattern) occurs in all texts: pattern, total.

    A Bloom filter of bounded size keeps the others back in the scan, batches are counted before they are shuffled; a join decides."""
    passing = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("pattern").alias("h")), filter_bits(wanted.count())))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_buffer(batch.column(0))
        _, patterns, *_ = _words(raw, offsets)
        flat = patterns.reshape(-1)
        keys, counts = np.unique(flat[in_bloom(passing.value, flat) & (flat != 0)], return_counts=True)
        yield pa.record_batch([pa.array(keys), pa.array(counts.astype(np.int64))], ["pattern", "n"])

    found = map_arrow(docs.select("text"), count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return found.join(wanted, "pattern", "left_semi")


def find_personal_data(docs: DataFrame, least_values: int = 3, confidence: float = 0.5, rounds: int = 3, made: list[str] | None = None) -> DataFrame:
    """doc_id, base and more (arrays of start, kind, end in code points) for each row of docs (doc_id, text).

    base has the spans of the fixed kinds, more the identifiers that the patterns found: a pattern of a kind is used if at least the
    share `confidence` of its occurrences precede identifiers and `least_values` different ones are confident. Null and empty texts
    have no spans; each row stands for itself, also with an equal or null doc_id; texts of any length are read whole, in linear time;
    an empty table gives no rows; further columns are ignored."""
    made = [] if made is None else made
    one = 1_000_000  # confidences are whole millionths, so that sums don't depend on their order
    least = round(confidence * one)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    rows = written(source.mapInArrow(_scan, _SCAN), "pii-rows", made)
    mention = written(rows.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*"), "pii-mentions", made)
    of_kind = F.expr(f"CASE WHEN kind IS NOT NULL THEN array(kind) ELSE filter(sequence(0, {len(KINDS) - 1}), k -> shiftright(kinds, k) & 1 = 1) END")
    edges = mention.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").isNotNull().alias("seed"), of_kind.alias("ks"))
    edges = edges.select("pattern", "value", "seed", F.explode("ks").alias("kind")).groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = written(edges, "pii-edges", made)
    # A pattern can only become confident with enough different values, and if they make up enough of its occurrences.
    bound = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).where(F.col("values") >= least_values)
    totals = _occurrences(docs, bound.select("pattern").distinct())
    able = bound.join(totals, "pattern").where(F.col("n") * one >= F.col("total") * least).select("pattern", "kind", F.greatest("total", "n").alias("total"))
    graph = written(edges.join(able, ["pattern", "kind"]), "pii-graph", made)
    sure = graph.where("seed").select("value", "kind").distinct().withColumn("r", F.lit(one).cast("long"))
    for _ in range(rounds):
        scored = graph.join(sure, ["value", "kind"]).groupBy("pattern", "kind").agg(
            F.floor(F.sum(F.col("n") * F.col("r")) / F.first("total")).cast("long").alias("confidence"), F.count(F.when(F.col("r") >= least, 1)).alias("values")
        )
        patterns = written(scored.where((F.col("confidence") >= least) & (F.col("values") >= least_values)), "pii-patterns", made)
        best = graph.join(patterns, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max(F.when(F.col("seed"), one).otherwise(F.least("confidence", F.lit(one)))).alias("r"))
        sure = written(best.unionByName(graph.where("seed").select("value", "kind", F.lit(one).cast("long").alias("r"))).groupBy("value", "kind").agg(F.max("r").cast("long").alias("r")), "pii-instances", made)
    slots = mention.where("kind IS NULL").select("rid", "start", "end", "kinds", F.explode("patterns").alias("pattern"))
    found = slots.join(patterns, "pattern").where(F.expr("shiftright(kinds, kind) & 1 = 1"))
    found = found.groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = found.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    return rows.drop("mentions").join(more, "rid", "left").select("doc_id", "base", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>")).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the fixed kinds' spans, and all spans as kind:start:end by start, then kind."""

    def joined(spans):
        names = F.array(*(F.lit(k) for k in KINDS))
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans")
    )
