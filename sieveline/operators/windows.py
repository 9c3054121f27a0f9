"""Token windows and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def starts(n: Column, size: int = fixed.WINDOW, stride: int = fixed.STRIDE, training: bool = False) -> Column:
    """Starts of the windows of a sequence of n tokens. Up to size there is one; beyond, scoring steps to the end of the
    sequence, training stops as soon as the end is covered."""
    last = F.when(n <= size, 0).otherwise((F.ceil((n - size) / stride) * stride) if training else (F.floor((n - 1) / stride) * stride))
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def windows(rows: DataFrame, tokens: str, size: int = fixed.WINDOW, stride: int = fixed.STRIDE, training: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row for each window: the columns of carry, window_index, start, window (tokens)."""
    n = F.size(tokens)
    out = rows.where(n > 0).select(*(carry or [c for c in rows.columns if c != tokens]), F.col(tokens).alias("__t"), F.posexplode(starts(n, size, stride, training)).alias("window_index", "start"))
    return out.withColumn("window", F.slice("__t", F.col("start") + 1, size)).drop("__t")


def padded(window: Column, size: int = fixed.WINDOW, pad: str = "[PAD]") -> Column:
    return F.concat(window, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(window))))


def mask(window: Column, size: int = fixed.WINDOW) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(window)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(size) - F.size(window))))


def softmax2(benign: Column, malicious: Column) -> tuple[Column, Column]:
    p = 1 / (1 + F.exp(benign - malicious))
    return 1 - p, p


def best_window(rows: DataFrame, keys: list[str], p: str, index: str) -> DataFrame:
    """For each key the window with the largest probability, the first of equals: keys, p, index, n windows."""
    best = F.max(F.struct(F.col(p).alias("p"), (-F.col(index)).alias("i")))
    return rows.groupBy(*keys).agg(best.alias("__b"), F.count("*").alias("window_count")).select(*keys, F.col("__b.p").alias(p), (-F.col("__b.i")).alias(index), "window_count")
