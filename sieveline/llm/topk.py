"""Exact top-k inner products on a bit-sliced index.

The index is a table of blocks of rows; a block keeps, for each attribute, bitmaps of the bits of its quantised value ("slices") and
nothing else of it. It is written once and read in each pass. For a query the
slices, weighted by the query's signed digits, are added with carry-save adders on bitmaps. The sum's slices are walked
from the most significant down to find the k-th largest value; rows that the quantisation can't rule out are resolved
exactly. Blocks are independent. The queries go round in chunks of a bounded size: each chunk is a pass over all blocks,
whose result is written before the next one begins, so neither the plan nor the driver grows with the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_paths, shared_dir, written

#: Rows of a block and bytes of the query chunk that each pass broadcasts.
BLOCK_ROWS = 16384
CHUNK_BYTES = 32 << 20
#: Low bits that the slices leave to the exact step.
DROPPED_BITS = 2


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(exponent, sign) of the value's non-adjacent form."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


class BitSlices:
    """Slices of a block of rows: bitmaps of the bits of each attribute's value above its least one. The lowest `dropped` bits have
    slices too, which only exact values need. Nothing else is kept of the values."""

    def __init__(self, rows: int, least: np.ndarray, bits: np.ndarray, maps: np.ndarray, dropped: int = DROPPED_BITS):
        self.rows, self.dropped, self.least, self.bits, self.maps = rows, dropped, least, bits, maps
        self.words = -(-rows // 64)
        ends = np.cumsum(bits)
        self.slices = [maps[e - n + dropped : e] if n > dropped else maps[:0] for e, n in zip(ends.tolist(), bits.tolist())]
        self.attribute = np.repeat(np.arange(len(bits)), bits)
        self.weight = np.int64(1) << (np.arange(len(maps)) - np.repeat(ends - bits, bits)).astype(np.int64)
        self.all = self._bitmap(np.ones(rows, bool))

    @classmethod
    def of(cls, values: np.ndarray, dropped: int = DROPPED_BITS) -> BitSlices:
        """Of int64 values of shape (rows, attributes)."""
        rows = len(values)
        least = values.min(0) >> dropped if rows else np.zeros(values.shape[1], np.int64)
        above = values - (least << dropped)
        bits = np.array([max(int(x).bit_length(), dropped) for x in above.max(0)] if rows else [0] * values.shape[1], np.int64)
        out = cls(rows, least, bits[:0], np.zeros((0, -(-rows // 64)), np.uint64), dropped)
        maps = [out._bitmap((above[:, j] >> b) & 1 > 0) for j, n in enumerate(bits.tolist()) for b in range(n)]
        return cls(rows, least, bits, np.stack(maps) if maps else out.maps, dropped)

    @classmethod
    def stored(cls, rows: int, least: bytes, bits: bytes, maps: bytes, dropped: int = DROPPED_BITS) -> BitSlices:
        """As parts() gave them."""
        return cls(rows, np.frombuffer(least, np.int64), np.frombuffer(bits, np.int64), np.frombuffer(maps, np.uint64).reshape(-1, -(-rows // 64)), dropped)

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.rows, self.least.tobytes(), self.bits.tobytes(), self.maps.tobytes()

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, bool)
        padded[: self.rows] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def _bits_of(self, rows: np.ndarray) -> np.ndarray:
        """Bits of some rows in all slices, as int64 of shape (slices, rows)."""
        return ((self.maps[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Exact values of some rows, put together from the slices."""
        out = np.zeros((len(self.bits), len(rows)), np.int64)
        np.add.at(out, self.attribute, self._bits_of(rows) * self.weight[:, None])
        return (out + (self.least << self.dropped)[:, None]).T

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact products of some rows with a query."""
        return (query[self.attribute] * self.weight) @ self._bits_of(rows) + (query * (self.least << self.dropped)).sum()

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sum of query * quantised value over the attributes, and the constant that they leave out."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for j, q in enumerate(query.tolist()):
            own = self.slices[j]
            constant += q * int(self.least[j])
            for exponent, sign in signed_digits(q):
                # -b is (1 - b) - 1: a subtracted slice is its complement and a constant
                bitmaps = own if sign > 0 else ~own & self.all
                for b in range(len(own)):
                    columns.setdefault(exponent + b, []).append(bitmaps[b : b + 1])
                if sign < 0:
                    constant -= ((1 << len(own)) - 1) << exponent
        out, weight = [], 0
        while columns:
            stack = columns.pop(weight, None)
            if stack is not None:
                rows = np.concatenate(stack)
                while len(rows) > 1:
                    if len(rows) == 2:
                        a, b = rows[:1], rows[1:]
                        columns.setdefault(weight + 1, []).append(a & b)
                        rows = a ^ b
                        continue
                    m = len(rows) // 3
                    a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                    half = a ^ b
                    columns.setdefault(weight + 1, []).append((a & b) | (c & half))
                    rows = np.concatenate([half ^ c, rows[3 * m :]])
                out.append(rows[0])
            else:
                out.append(np.zeros(self.words, np.uint64))
            weight += 1
        return out, constant

    def candidates(self, query: np.ndarray, k: int, alive: np.ndarray) -> np.ndarray:
        """Rows that can be among the k with the largest exact product: a superset, by the slices alone."""
        sums, _ = self.add(query)
        sure, tied, kth = np.zeros(self.words, np.uint64), alive, 0
        for weight in range(len(sums) - 1, -1, -1):
            more = sure | (tied & sums[weight])
            n = int(np.bitwise_count(more).sum())
            if n >= k:
                tied = tied & sums[weight]
                kth |= 1 << weight
            else:
                sure, tied = more, tied & ~sums[weight]
        # exact = (sum << dropped) + remainder, and the remainder lies in a range of this width
        width = ((1 << self.dropped) - 1) * int(np.abs(query).sum())
        floor = max(kth - (-(-width >> self.dropped)), 0)
        above, equal = np.zeros(self.words, np.uint64), alive
        for weight in range(max(len(sums), floor.bit_length()) - 1, -1, -1):
            own = sums[weight] if weight < len(sums) else np.zeros(self.words, np.uint64)
            if floor >> weight & 1:
                equal = equal & own
            else:
                above, equal = above | (equal & own), equal & ~own
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), count=self.rows, bitorder="little"))

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own_row: int = -1) -> list[tuple[int, int]]:
        """(row, score) of the k largest products, ties to the smaller id, without own_row."""
        alive = self.all
        if own_row >= 0:
            alive = alive.copy()
            alive[own_row // 64] &= ~np.uint64(1 << (own_row % 64))
        live = self.rows - (own_row >= 0)
        if live <= k:
            rows = np.array([r for r in range(self.rows) if r != own_row], np.int64)
        else:
            rows = self.candidates(query, k, alive)
        scores = self.scores(query, rows)
        order = np.lexsort((rows, ids[rows], -scores))[:k]
        return [(int(rows[i]), int(scores[i])) for i in order]


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    """The vectors that are not null and hold only finite components."""
    x = F.col(embedding)
    return vectors.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))))


def check_range(vectors: DataFrame, embedding: str, levels: int) -> None:
    """Raise OverflowError if a product of usable vectors might not fit into 64 bits."""
    x = F.col(embedding)
    most = vectors.agg(F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))).alias("x"), F.max(F.size(x)).alias("n")).first()
    # with the low bits that the index rounds off, and a bit for the sign
    if most["x"] is not None and most["n"] * (int(most["x"] * levels) + 2) ** 2 >= 1 << 62:
        raise OverflowError(f"{most['n']} components of up to {most['x']:g} at {levels} levels give products of more than 62 bits")


def quantised(vectors: DataFrame, key: str, embedding: str, levels: int) -> DataFrame:
    """(id, q): floor(levels * component) of usable vectors."""
    return vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * levels).cast("long")).alias("q"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max()) if len(sizes) else 0, width or 0)
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_inner_products(vectors: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", every: int = 50, levels: int = 256, block_rows: int = BLOCK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each row whose id is divisible by `every`: its k best other rows by integer inner product: query_id, rank, vec_id, score.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded with zeros.
    Ties go to the smaller id; rows that repeat an id are rows of their own, as queries and as candidates (the query's own
    row alone is left out). A null id is no query, and as a candidate comes first among ties. Other columns don't matter; an
    empty table has no result. Where components are so large that a product might not fit into 62 bits, OverflowError is
    raised. The result is read from tables written to the shared folder."""
    spark, made = vectors.sparkSession, []
    vectors = usable(vectors, embedding)
    check_range(vectors, embedding, levels)
    flat = quantised(vectors, key, embedding, levels)

    def pack(batches):
        from pyspark import TaskContext

        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block():
            nonlocal seq
            table = pa.Table.from_batches(held).combine_chunks()
            out = pa.record_batch([pa.array([part * (1 << 32) + seq], pa.int64()), pa.array([table.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], t) for x, t in zip(BitSlices.of(_matrix(table.column(1))).parts(), (pa.int64(), pa.binary(), pa.binary(), pa.binary())))], names=["block", "ids", "n", "least", "bits", "slices"])
            seq += 1
            return out

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(block_rows - rows, b.num_rows - at)
                held.append(b.slice(at, take))
                rows, at = rows + take, at + take
                if rows == block_rows:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    index = written(flat.mapInArrow(pack, "block long, ids array<long>, n long, least binary, bits binary, slices binary"), "bsi-index", made)

    def queries_of(batches):
        for b in batches:
            for block, ids, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = [r for r, i in enumerate(ids) if i is not None and i % every == 0]
                if own:
                    matrix = BitSlices.stored(*parts).values(np.array(own))
                    yield pa.record_batch([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array([ids[r] for r in own], pa.int64()), pa.array([x.tobytes() for x in matrix], pa.binary())], names=["block", "row", "id", "query"])

    queries = written(index.mapInArrow(queries_of, "block long, row long, id long, query binary"), "bsi-queries", made)
    size = queries.agg(F.coalesce(F.sum(F.length("query") + 24), F.lit(0)).alias("bytes")).first()
    chunks = max(1, -(-int(size["bytes"]) // chunk_bytes))
    folder, columns = shared_dir(spark, "bsi-best"), "query_id long, rank int, vec_id long, score long"
    for c in range(chunks):
        own = queries.where(F.pmod(F.xxhash64("block", "row"), F.lit(chunks)) == c).toLocalIterator()
        shared = spark.sparkContext.broadcast([(q["block"], q["row"], q["id"], bytes(q["query"])) for q in own])

        def search(batches, shared=shared):
            for b in batches:
                for block, ids, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    slices, order_ids = BitSlices.stored(*parts), np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
                    out = []
                    for q_block, q_row, q_id, data in shared.value:
                        # components that the block's vectors lack meet zeros there, and the other way round
                        query, given = np.zeros(len(slices.bits), np.int64), np.frombuffer(data, np.int64)[: len(slices.bits)]
                        query[: len(given)] = given
                        for row, score in slices.top(query, k, order_ids, q_row if q_block == block else -1):
                            out.append((q_block, q_row, q_id, block, row, ids[row], score))
                    if out:
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["q_block", "q_row", "query_id", "block", "row", "vec_id", "score"])

        hits = index.mapInArrow(search, "q_block long, q_row long, query_id long, block long, row long, vec_id long, score long")
        # the chunk's queries have all their hits in this pass: their best k are final
        order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"), "block", "row")
        hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        shared.destroy()
    drop_paths(spark, made)
    return spark.read.schema(columns).parquet(folder)
