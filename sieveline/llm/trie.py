"""Conversation prefix trie: every distinct beginning of a conversation as a node, by an external mergesort that knows common prefixes.

A turn becomes a symbol of 20 bytes (half a SHA-256 of role and text, then the code points of the text), a conversation the
bytes of its symbols. Spark deals the conversations out by ranges of (bytes, conversation). A task sorts runs that fit in memory,
stores each with the length of the common prefix (LCP) of neighbours, and merges them with a loser tree that compares from known
LCPs on, so shared turns aren't compared again. The merged stream feeds a stack of open nodes; a node is done when the stream
leaves it. Nodes on the paths of a range's first and last conversation may go on in other ranges: of those the task gives parts,
and one fold over these few (two paths a range) joins them. A hot beginning is thus spread over ranges.

One conversation is one row of 20 bytes a turn. SHA-256 of a node's conversations can't be split, so one task reads them, in pieces.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_paths, small_batches, written

#: Bytes of a symbol: of the digest and of the length.
DIGEST, SYMBOL = 16, 20
#: Conversations in a piece of the list of those that end at a node.
PIECE = 4096


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns' symbols (hex strings) in order of turn, null first.

    Rows without conv_id belong to no conversation; null role or text is empty. Equal turn numbers go by role, then by the digest
    of role and text; repeated rows stay. Further columns are ignored; an empty table has no sequences."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    symbol = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))
    one = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn"), role.alias("role"), symbol.alias("symbol")).alias("turn"))
    return one.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x["symbol"]).alias("turns"))


def rebuilt(seqs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation behind the first h turns of its group's first one (c - c % group) in place of its own first h; h = crc32(c) % most."""
    c = F.col("conv_id")
    heads = seqs.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    own = seqs.withColumns({"base": c - c % group, "h": h}).join(heads, "base", "left")
    head = F.coalesce("head", F.array().cast("array<string>"))
    return own.select("conv_id", F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes, at: int, size: int = SYMBOL) -> int:
    """Symbols that a and b share at their beginning, given that they share `at`."""
    most = min(len(a), len(b)) // size
    step = 1
    while at < most:
        step = min(step, most - at)
        if a[at * size : (at + step) * size] == b[at * size : (at + step) * size]:
            at, step = at + step, step * 2
        elif step == 1:
            break
        else:
            step = 1
    return at


class _Run:
    """A sorted run in a file of the task: (LCP with the one before, key, conversation)."""

    HEAD = struct.Struct("<qqq")

    def __init__(self, items: list[tuple[bytes, int]]):
        items.sort()
        self.file = tempfile.TemporaryFile()
        before = None
        for key, conv in items:
            self.file.write(self.HEAD.pack(common(before, key, 0) if before is not None else 0, len(key), conv) + key)
            before = key
        self.file.seek(0)

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        while head := self.file.read(self.HEAD.size):
            lcp, n, conv = self.HEAD.unpack(head)
            yield lcp, self.file.read(n), conv
        self.file.close()


class LoserTree:
    """Merges sorted runs of (LCP with the run's last, key, number): yields the same, the LCP being with the last one yielded.

    Each waiting item knows its LCP with the last winner. The longer one is the smaller item, without looking at the keys;
    where both are equal, the comparison starts behind it and leaves the loser its new LCP."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.items: list = [None] * len(runs)
        self.compared = 0

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's item comes before run b's; the loser's LCP is set to that with the winner."""
        x, y = self.items[a], self.items[b]
        if x is None or y is None:
            return y is None
        if x[0] != y[0]:
            return x[0] > y[0]
        at = common(x[1], y[1], x[0])
        self.compared += at - x[0] + 1
        less = (x[1][at * SYMBOL : (at + 1) * SYMBOL], len(x[1]), x[2]) < (y[1][at * SYMBOL : (at + 1) * SYMBOL], len(y[1]), y[2])
        (y if less else x)[0] = at
        return less

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        k = len(self.runs)
        if not k:
            return
        for i in range(k):
            first = next(self.runs[i], None)
            self.items[i] = [0, *first[1:]] if first else None
        losers = [-1] * k

        def up(node: int) -> int:
            """The winner below a node; losers stay on the way."""
            if node >= k:
                return node - k
            a, b = up(2 * node), up(2 * node + 1)
            a, b = (a, b) if self._less(a, b) else (b, a)
            losers[node] = b
            return a

        winner = up(1) if k > 1 else 0
        while (item := self.items[winner]) is not None:
            yield tuple(item)
            following = next(self.runs[winner], None)
            self.items[winner] = list(following) if following else None
            node = (winner + k) // 2
            while node:
                if self._less(losers[node], winner):
                    losers[node], winner = winner, losers[node]
                node //= 2


def _digests(key: bytes) -> list[bytes]:
    """Of each beginning of the key, the root's first."""
    h, out = hashlib.sha256(b"node"), []
    out.append(h.digest()[:DIGEST])
    for at in range(0, len(key), SYMBOL):
        h.update(key[at : at + SYMBOL])
        out.append(h.copy().digest()[:DIGEST])
    return out


class _Open:
    """An open node: counts of what is closed below it and of the conversations that end at it."""

    __slots__ = ("children", "edge", "first", "hash", "leaves", "n", "saved")

    def __init__(self, edge: bool):
        self.n, self.first, self.children, self.leaves, self.saved, self.edge, self.hash = 0, None, 0, 0, 0, edge, None

    def add(self, n: int, first: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)


def _length(key: bytes, depth: int) -> int:
    return int.from_bytes(key[depth * SYMBOL - 4 : depth * SYMBOL], "big") if depth else 0


_DONE = struct.Struct("<qqqqqq32s?q")
_NONE = hashlib.sha256(b"").digest()

NODES = (
    "kind int, part int, side int, depth long, digest binary, parent binary, chars long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends binary, piece long, ids binary"
)
#: Kinds of rows: a node; a node whose parent may go on elsewhere; a part of such; conversations that end at one.
DONE, HANGING, PART, ENDS = range(4)


def _arrow(spark_type: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[spark_type]


def _batches(rows: Iterator[dict], schema: str, size: int = 8192) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([(x.split()[0], _arrow(x.split()[1])) for x in schema.split(", ")])
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, fields)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, fields)


def nodes_of_stream(stream: Iterator[tuple[int, bytes, int]], part: int) -> Iterator[dict]:
    """Rows (NODES) of the sorted conversations of one range: what is done, in reverse order, and the parts on both edges."""
    done = tempfile.TemporaryFile()
    stack: list[_Open] = []
    key, left, edges = b"", [], {}  # edges: what a part's row needs, by its number
    group = tempfile.SpooledTemporaryFile(1 << 20)  # conversations that end at the top
    first_group, top = None, None

    def close(last: bool) -> None:
        depth = len(stack) - 1
        node = stack.pop()
        ends = node.hash.digest() if node.hash else _NONE
        if node.edge or last:
            at = len(edges)
            edges[at] = {"depth": depth, "chars": _length(key, depth), "conv_id": node.first, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends": ends if node.hash else None, "side": 0 if node.edge else 1}
            done.write(_DONE.pack(depth, 0, 0, 0, 0, 0, ends, True, at))
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * _length(key, depth)
        done.write(_DONE.pack(depth, node.first, node.n, node.children, leaves, saved, ends, False, 0))
        stack[-1].add(node.n, node.first, 1, leaves, saved)

    def pieces(file, digest: bytes) -> Iterator[dict]:
        file.seek(0)
        number = 0
        while ids := file.read(8 * PIECE):
            yield {"kind": ENDS, "part": part, "digest": digest, "piece": number, "ids": ids}
            number += 1

    for lcp, now, conv in stream:
        depth = len(now) // SYMBOL
        if not stack:
            stack, left = [_Open(True) for _ in range(depth + 1)], _digests(now)
        else:
            while len(stack) - 1 > lcp:
                close(False)
            stack += [_Open(False) for _ in range(len(stack), depth + 1)]
        key = now
        node = stack[-1]
        if node is not top:
            if first_group is None and top is not None:
                first_group, group = group, tempfile.SpooledTemporaryFile(1 << 20)
            top = node
            group.seek(0)
            group.truncate()
            node.hash = hashlib.sha256(str(conv).encode())
        else:
            node.hash.update(b",%d" % conv)
        node.add(1, conv, 0, 0, 0)
        group.write(struct.pack("<q", conv))
    if not stack:
        return
    right = _digests(key)
    yield from pieces(group, right[-1])
    if first_group is not None:
        yield from pieces(first_group, left[-1])
    # The conversations that end at the two edges' own nodes come in pieces; those of the nodes above are complete.
    top.hash = None
    while stack:
        close(True)
    where: dict[int, tuple[int | None, bytes | None]] = {}  # by depth: the last node above, in reverse order
    at = done.tell()
    while at:
        block = min(at, _DONE.size * PIECE)
        at -= block
        done.seek(at)
        for row in reversed(list(_DONE.iter_unpack(done.read(block)))):
            depth, conv, n, children, leaves, saved, ends, edge, number = row
            if edge:
                x = edges.pop(number)
                path = left if x["side"] == 0 else right
                if x["side"] == 0 and depth == len(left) - 1:
                    x["ends"] = None
                where[depth] = (None, path[depth])
                yield {"kind": PART, "part": part, "digest": path[depth], "parent": path[depth - 1] if depth else None, **x}
            else:
                above, digest = where[depth - 1]
                where[depth] = (conv, None)
                yield {"kind": DONE if digest is None else HANGING, "part": part, "parent": digest, "depth": depth, "conv_id": conv, "parent_conv_id": above, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends}
    done.close()


def _sorted_nodes(run_bytes: int, fan_in: int):
    """Function for mapInArrow: the nodes of one range."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs, items, held = [], [], 0
        for b in batches:
            for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                items.append((key, conv))
                held += len(key) + 100
                if held >= run_bytes:
                    runs.append(_Run(items))
                    items, held = [], 0
                    if len(runs) >= fan_in:
                        runs = [_merged(runs)]
        if items:
            runs.append(_Run(items))
        context = TaskContext.get()
        yield from _batches(nodes_of_stream(iter(LoserTree(runs)), context.partitionId() if context else 0), NODES)

    return run


def _merged(runs: list[_Run]) -> _Run:
    """Several runs as one, by the loser tree; its LCPs are those of the new neighbours."""
    out = _Run([])
    for lcp, key, conv in LoserTree(runs):
        out.file.write(_Run.HEAD.pack(lcp, len(key), conv) + key)
    out.file.seek(0)
    return out


_PARTS = "digest binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def fold_parts(rows: Iterator[dict]) -> Iterator[dict]:
    """Joins the parts of nodes, which come in the order of the ranges, each path from the root on. Holds one path."""
    stack: list[tuple[dict, _Open]] = []

    def close() -> dict:
        x, node = stack.pop()
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * x["chars"]
        if stack:
            stack[-1][1].add(node.n, node.first, 1, leaves, saved)
        return {k: x[k] for k in ("digest", "parent", "depth", "ends")} | {"conv_id": node.first, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved}

    for x in rows:
        if len(stack) <= x["depth"] or stack[x["depth"]][0]["digest"] != x["digest"]:
            while len(stack) > x["depth"]:
                yield close()
            stack.append((x, _Open(True)))
        have, node = stack[x["depth"]]
        have["ends"] = have["ends"] or x["ends"]
        node.add(x["n_convs"], x["conv_id"], x["n_children"], x["n_leaves"], x["saved_tokens"])
    while stack:
        yield close()


def _fold(batches) -> Iterator[pa.RecordBatch]:
    yield from _batches(fold_parts(x for b in batches for x in b.to_pylist()), _PARTS)


def _hash_pieces(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined conversations of each node, from pieces in order."""
    import numpy as np

    def rows() -> Iterator[dict]:
        digest, h = None, None
        for b in batches:
            for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist()):
                text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
                if d != digest:
                    if h:
                        yield {"digest": digest, "hash": h.digest()}
                    digest, h = d, hashlib.sha256(text)
                else:
                    h.update(b"," + text)
        if h:
            yield {"digest": digest, "hash": h.digest()}

    yield from _batches(rows(), "digest binary, hash binary")


def prefix_trie(seqs: DataFrame, run_bytes: int = 64 << 20, fan_in: int = 64, partitions: int | None = None) -> DataFrame:
    """Nodes of the trie of `seqs` (conv_id, turns as symbols; see sequences): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256 for each distinct beginning. Empty conversations are members of the root; without any
    conversation there are no nodes. conv_id must be distinct. run_bytes bounds what a task sorts in memory, fan_in its open files."""
    spark, made = seqs.sparkSession, []
    keys = written(seqs.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join("turns", "")).alias("key")), "trie-keys", made)
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(keys.repartitionByRange(n, "key", "conv_id").mapInArrow(_sorted_nodes(run_bytes, fan_in), NODES), "trie-nodes", made)
    parts = found.where(F.col("kind") == PART)
    ordered = parts.drop("kind", "piece", "ids", "parent_conv_id").repartition(1).sortWithinPartitions("part", "side", "depth")
    folded = ordered.mapInArrow(_fold, _PARTS)
    hashes = found.where(F.col("kind") == ENDS).select("digest", "part", "piece", "ids").repartition("digest").sortWithinPartitions("digest", "part", "piece").mapInArrow(_hash_pieces, "digest binary, hash binary")
    edges = written(folded.join(hashes, "digest", "left").withColumn("ends", F.coalesce("hash", "ends", F.lit(_NONE))), "trie-edges", made)
    drop_paths(spark, made[:1])
    parents = edges.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    # Nodes that hang on an edge meet their parent by range, as a range has but two paths; so a hot parent meets them nowhere at once.
    by_range = parts.select("part", F.col("digest").alias("parent")).join(parents, "parent")
    hanging = found.where(F.col("kind") == HANGING).drop("parent_conv_id").join(by_range, ["part", "parent"]).withColumnRenamed("above", "parent_conv_id")
    linked = edges.join(parents, "parent", "left").withColumnRenamed("above", "parent_conv_id")

    def out(df: DataFrame) -> DataFrame:
        return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))

    return out(found.where(F.col("kind") == DONE)).unionByName(out(hanging)).unionByName(out(linked))


def conversation_trie(turns: DataFrame, group: int = 100, most: int = 6, **how) -> DataFrame:
    """prefix_trie() of the rebuilt conversations of a table (conv_id, turn, role, text). See sequences() for nulls, ties and repeats."""
    made: list[str] = []
    seqs = written(sequences(turns), "trie-turns", made)
    out = prefix_trie(rebuilt(seqs, group, most), **how)
    drop_paths(turns.sparkSession, made)
    return out
