"""Training sets: first-wins deduplication, removal across classes, sampling, splits, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def dedupe_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key, nulls being one key, by an explicit order.

    min_by over the whole row combines on the map side, so a hot key doesn't meet in one task as in a window."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def common_hashes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides, null equal to null."""
    return a.select(key).intersect(b.select(key))


def benign_wins(benign: DataFrame, malicious: DataFrame, key: str, order: list) -> tuple[DataFrame, DataFrame]:
    """Both classes without repeats; the malicious one without keys of the benign one."""
    good, bad = dedupe_first(benign, key, order), dedupe_first(malicious, key, order)
    other = good.select(F.col(key).alias("__k"))
    return good, bad.join(other, F.col(key).eqNullSafe(F.col("__k")), "left_anti")


def dedupe_stats(benign: DataFrame, malicious: DataFrame, key: str) -> DataFrame:
    """Counts before and after, for each class."""
    side = lambda rows, name: rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    both = side(benign, "benign").unionByName(side(malicious, "malicious"))
    keys = both.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("side") == "benign", F.col("n"))), F.lit(0)).alias("b"), F.coalesce(F.max(F.when(F.col("side") == "malicious", F.col("n"))), F.lit(0)).alias("m"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    one = lambda c: c.cast("long")
    b, m = F.col("b"), F.col("m")
    return keys.agg(
        total(b, "benign_rows"), total(m, "malicious_rows"), total(one(b > 0), "benign_kept"), total(one((m > 0) & (b == 0)), "malicious_kept"),
        total(one((m > 0) & (b > 0)), "shared"),
    )


def union_enrich(rows: DataFrame, more: DataFrame, key: str, order: list) -> DataFrame:
    """Rows appended, missing columns null, then the first of each key."""
    return dedupe_first(rows.unionByName(more, allowMissingColumns=True), key, order)


def downsample_ratio(benign: DataFrame, malicious: DataFrame, ratio: float, key: list[str], seed: int = 42) -> DataFrame:
    """Of the benign rows int(malicious * ratio) in the shuffled order of their key columns, if they are more and the ratio is positive; else all. Rows are ranked by hash ranges, not sorted in one task."""
    if ratio <= 0:
        return benign
    keep = int(malicious.count() * ratio)
    return _ranked(benign, [], key, seed).where(F.col("__rank") <= keep).select(*benign.columns)


def shuffle_key(key: str | list[str], seed: int = 42) -> Column:
    """A reproducible random order: SHA-256 of the seed and the key."""
    parts = [F.col(k).cast("string") for k in ([key] if isinstance(key, str) else key)]
    return F.sha2(F.concat(F.lit(f"{seed}:"), *parts), 256)


def _ranked(rows: DataFrame, by: list[str], key: list[str], seed: int) -> DataFrame:
    """rows with __rank in the shuffled order within each group of `by`, from 1, and __total, the group's rows.

    Ranks are taken within ranges of the hash's first digits, to which the counts of the ranges before are added, so that no
    group is sorted in one task. Null keys come first."""
    h = rows.withColumn("__h", shuffle_key(key, seed)).withColumn("__b", F.coalesce(F.substring("__h", 1, 3), F.lit("")))
    sizes = h.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    totals = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__b").alias("__c"), (F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__total"))
    ranked = h.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *key)))
    same = F.col("__b") == F.col("__c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return ranked.join(totals, same).withColumn("__rank", F.col("__before") + F.col("__r")).select(*rows.columns, "__rank", "__total")


def stratified_split(rows: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_test: of each label the first ceil(test * n) in the shuffled order."""
    ranked = _ranked(rows, [label], [key], seed)
    return ranked.withColumn("is_test", F.col("__rank") <= F.ceil(F.col("__total") * F.lit(test))).select(*rows.columns, "is_test")


def label_union(benign: DataFrame, malicious: DataFrame, label: str = "label") -> DataFrame:
    return benign.withColumn(label, F.lit(0)).unionByName(malicious.withColumn(label, F.lit(1)))


def load_nonblank(rows: DataFrame, column: str) -> DataFrame:
    """The column without nulls and blanks, trimmed; none if the column is missing."""
    if column not in rows.columns:
        return rows.sparkSession.createDataFrame([], f"{column} string")
    t = F.regexp_replace(F.col(column).cast("string"), r"(?U)^\s+|\s+\z", "")
    return rows.select(t.alias(column)).where(F.col(column) != "")


def split_tokens(c: Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def token_frequency(rows: DataFrame, text: str, key: str) -> DataFrame:
    """token, count, and first: the place (key, position) where it comes first."""
    each = rows.select(F.col(key).alias("k"), F.posexplode(split_tokens(F.col(text))).alias("i", "token"))
    return each.groupBy("token").agg(F.count("*").alias("count"), F.min(F.struct("k", "i")).alias("first"))


def top_tokens(rows: DataFrame, text: str, key: str, base: list[str], n: int) -> DataFrame:
    """The base tokens, then others by count until there are n; of equals that which came first. token, count, is_base.

    Base tokens go into the one aggregate as rows that count nothing, so the texts are read and counted once."""
    each = rows.select(F.col(key).alias("k"), F.posexplode(split_tokens(F.col(text))).alias("i", "token"))
    each = each.select("token", F.lit(1).cast("long").alias("c"), F.struct("k", "i").alias("at"), F.lit(False).alias("base"))
    first = rows.sparkSession.createDataFrame([(t,) for t in sorted(set(base))], "token string")
    first = first.select("token", F.lit(0).cast("long").alias("c"), F.lit(None).cast(each.schema["at"].dataType).alias("at"), F.lit(True).alias("base"))
    found = each.unionByName(first).groupBy("token").agg(F.sum("c").alias("count"), F.min("at").alias("first"), F.max("base").alias("is_base"))
    return found.orderBy(F.desc("is_base"), F.desc("count"), "first").limit(max(n, len(set(base)))).select("token", "count", "is_base")


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """word and count: exact counts of the words that the tokenizers library trains on, NFKC and its Whitespace split. Null texts have none."""

    def split(batches):
        from collections import Counter

        import pyarrow as pa
        from tokenizers import normalizers, pre_tokenizers

        normal, pre = normalizers.NFKC(), pre_tokenizers.Whitespace()
        for batch in batches:
            chunks, words = Counter(), Counter()
            for value in batch.column(0).to_pylist():
                if value:
                    chunks.update((value if value.isascii() else normal.normalize_str(value)).split(" "))
            for chunk, n in chunks.items():
                for word, _ in pre.pre_tokenize_str(chunk):
                    words[word] += n
            yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "count"])

    return rows.select(text).mapInArrow(split, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def bpe_vocabulary(rows: DataFrame, text: str, size: int, special: list[str]):
    """A tokenizer trained on the exact counts of all words: NFKC, blanks, minimal frequency 2, special tokens whole.

    Words are split, counted and merged on the executors; the driver holds pairs of tokens, not words (see bpe_train)."""
    from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

    from .bpe_train import merges

    special = ["[UNK]", "[PAD]", *special]
    vocab, pairs = merges(word_counts(rows, text), size, special)
    tokenizer = Tokenizer(models.BPE(vocab, pairs, unk_token="[UNK]"))
    tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.NFKC(), pre_tokenizers.Whitespace()
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in special])
    return tokenizer


def chunk_rows(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with chunk: consecutive runs of `size` in the order, numbered from 0, without a global sort in one task.

    The rows are dealt into ranges and written once, so that counting and ranking see the same ranges."""
    parts = written(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__p").alias("__q"), (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    ranked = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    return ranked.join(before, F.col("__p") == F.col("__q")).withColumn("chunk", F.floor((F.col("__before") + F.col("__r") - 1) / size)).select(*rows.columns, "chunk")


def load_rows(rows: DataFrame) -> DataFrame:
    """Training rows whose tokens aren't null or blank."""
    return rows.where(F.regexp_replace("tokens", r"(?U)\s+", "") != "")
