"""Helpers shared by the training-data operators."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of an Arrow batch: documents can be long, so a batch is kept to a few megabytes.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir)."""
    return shared_folder(spark, what)


def written(df: DataFrame, what: str, made: list[str] | None = None) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, so lost executors cost no recomputation.

    The path goes to `made`, for drop_paths() once nothing reads the table any more."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nobody refers to any more."""
    import gc

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of intermediate results through the Hadoop file system."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts end to end, and offsets of len + 1; null counts as empty. No copy of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(raw: np.ndarray, word_byte: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each word in a batch's bytes, and for each text the number of its first word (len + 1).

    word_byte: table of 256 booleans; a word never crosses a text's end."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_byte[raw]
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | starts_text[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | starts_text[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_places(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of the bytes. Each eight bytes are mixed together with their place, then summed: unlike a polynomial
    modulo 2^64, this tells words apart that differ by a pattern of swaps only (Thue-Morse words)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    lengths = end - start
    out = mix64((eight[start] & _MASKS[np.minimum(lengths, 8)]) ^ _GOLDEN)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) // 8  # further blocks of each word
        first = np.cumsum(more) - more
        number = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[long], more) + 8 * number
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        blocks = mix64((eight[at] & _MASKS[left]) ^ mix64((number.astype(np.uint64) + np.uint64(1)) * _GOLDEN))
        out[long] += np.add.reduceat(blocks, first)
    return mix64(out ^ (lengths.astype(np.uint64) << np.uint64(40)))


def hash_words(raw: np.ndarray, word_byte: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words in a batch, and for each text the number of its first word (len + 1). For each of prefixes there
    follow the hashes of the words' first so many bytes (of the whole word, if it's shorter)."""
    start, end, first = word_places(raw, word_byte, offsets)
    return (hash_places(raw, start, end), first, *(hash_places(raw, start, np.minimum(start + p, end)) for p in prefixes))


_TABLES: dict = {}


def worker_table(key, make: Callable):
    """What a worker keeps from task to task: the tables of one operator at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, tables: bool = False) -> DataFrame:
    """mapInArrow with a function of one batch. Unless it uses such itself, the worker lets go of other operators' tables first."""

    def run(batches):
        if not tables:
            _TABLES.clear()
        for b in batches:
            if b.num_rows:
                yield from per_batch(b)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of slices of a table, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


#: Bits of a Bloom filter: of the smallest, and of the largest (a broadcast of 16 MB).
FILTER_BITS = (20, 27)


def filter_bits(entries: int) -> int:
    """Binary logarithm of the bits of a filter for so many entries, within FILTER_BITS: 8 bits each, as far as the bound allows."""
    return min(max((8 * entries).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2^bits bits of the column h (64-bit hashes), built by a native aggregation. Full filters let everything pass."""
    mask = (1 << bits) - 1
    found = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 64 - bits))).alias("bit"))
    words = found.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) the filter lets pass."""
    bits = len(words).bit_length() - 1 + 6
    h = np.asarray(hashes).view(np.uint64)
    out = np.ones(len(h), bool)
    for at in (h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", what: str = "cc", made: list[str] | None = None) -> DataFrame:
    """Vertices of the edges with the smallest vertex of their component: (v, comp). Distributed.

    Each round hooks every vertex onto its smallest neighbour and contracts the graph; vertices should be hashes, so that
    the expected number of rounds is logarithmic. Only counts reach the driver; every round is a written table."""
    spark = edges.sparkSession
    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{what}-edges", made)
    parents = []
    while e.limit(1).count():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        parent = written(hooked, f"{what}-parent", made)
        parents.append(parent)
        e = written(
            e.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            f"{what}-edges",
            made,
        )
    if not parents:
        return edges.select(F.col(a).alias("v"), F.col(a).alias("comp")).limit(0)
    comp = parents[-1].select("v", F.col("p").alias("comp"))
    for parent in reversed(parents[:-1]):
        comp = parent.join(comp.withColumnRenamed("v", "p"), "p", "left").select("v", F.coalesce("comp", "p").alias("comp"))
    return written(comp, f"{what}-comp", made)
