"""Corpora of repositories: a list of addresses with pinned commits, held against the checkouts in a landing folder.

A checkout is a folder named after its repository and, if it is pinned, the first eight digits of the commit. Fetching is left to git and
whoever runs it; what is here says which checkouts are missing or at another commit, and reads those that are right."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files

CORPUS = "url string, label int, name string, commit string, folder string"
#: Classes of a list, as its keys begin.
CLASSES = {"benign_repositories": 0, "malicious_repositories": 1}


def repository_name(url: Column) -> Column:
    """The last part of an address's path, without a closing slash and .git; of an address without a path it is empty."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"[.]git$", ""), "([^/]*)$", 1)


def read_corpora(spark: SparkSession, path: str, limit: int = 32 << 20) -> DataFrame:
    """Rows (CORPUS) of a JSON list: {"benign_repositories": {address: {"commit_hash": ...}}, "malicious_repositories": ...}.

    commit is null where none is pinned. A list is written by people; its size is checked, as the driver reads it. An address in both classes
    is in both; one that is repeated in a class is JSON's last."""
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit).select("content").first()
    if raw is None:
        raise ValueError(f"no list of at most {limit} bytes: {path}")
    spec = json.loads(bytes(raw["content"]))
    rows = [(url, label, (entry or {}).get("commit_hash") or None) for key, label in CLASSES.items() for url, entry in (spec.get(key) or {}).items()]
    return with_folders(spark.createDataFrame(rows, "url string, label int, commit string"))


def with_folders(rows: DataFrame) -> DataFrame:
    """Rows (CORPUS) of url, label and commit: the name of each repository and of its checkout's folder."""
    name = repository_name(F.col("url"))
    commit = F.lower(F.nullif(F.trim("commit"), F.lit("")))
    folder = F.concat(F.col("name"), F.coalesce(F.concat(F.lit("_"), F.substring("commit", 1, 8)), F.lit("")))
    return rows.select("url", "label", name.alias("name"), commit.alias("commit")).withColumn("folder", folder)


def heads(spark: SparkSession, root: str) -> DataFrame:
    """folder, head: the commit that each checkout below a folder stands at; null if its branch has none.

    A head is a commit or the name of a branch; a branch has a file of its own or a line in packed-refs, of which the file counts."""
    below = root.rstrip("/") + "/*/.git/"
    read = lambda patterns: _texts(spark, [below + p for p in patterns]).select(F.regexp_extract("path", r"/([^/]+)/[.]git/", 1).alias("folder"), F.regexp_extract("path", r"/[.]git/(.*)$", 1).alias("place"), "text")
    head = read(["HEAD"]).select("folder", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("h"))
    own = read(["refs/heads/*", "refs/heads/*/*"]).select("folder", F.col("place").alias("ref"), F.regexp_extract("text", "([0-9a-f]{40,64})", 1).alias("c"), F.lit(0).alias("order"))
    line = F.explode(F.split("text", "\n"))
    packed = read(["packed-refs"]).select("folder", line.alias("line")).where(F.col("line").rlike("^[0-9a-f]{40,64} refs/"))
    packed = packed.select("folder", F.trim(F.regexp_extract("line", " (.*)$", 1)).alias("ref"), F.regexp_extract("line", "^([0-9a-f]+)", 1).alias("c"), F.lit(1).alias("order"))
    refs = own.unionByName(packed).groupBy(F.col("folder").alias("__f"), "ref").agg(F.min_by("c", "order").alias("c"))
    ref = F.when(F.col("h").startswith("ref: "), F.substring("h", 6, 4096))
    found = head.withColumn("ref_", ref).join(refs, (F.col("folder") == F.col("__f")) & (F.col("ref_") == F.col("ref")), "left")
    return found.select("folder", F.when(F.col("ref_").isNull(), F.lower("h")).otherwise(F.col("c")).alias("head"))


def checkouts(spark: SparkSession, corpora: DataFrame, root: str) -> DataFrame:
    """corpora with head and status: ok (at the pinned commit), unpinned (there, none is pinned), other_commit, missing."""
    at = heads(spark, root).withColumnRenamed("folder", "__folder")
    status = F.when(F.col("__folder").isNull(), "missing").when(F.col("commit").isNull(), "unpinned").when(F.coalesce(F.col("head") == F.col("commit"), F.lit(False)), "ok").otherwise("other_commit")
    return corpora.join(at, F.col("folder") == F.col("__folder"), "left").select(*corpora.columns, "head", status.alias("status"))


def corpus_files(spark: SparkSession, corpora: DataFrame, root: str, extensions: list[str] | None = None, pinned_only: bool = False) -> DataFrame:
    """read_files() of the right checkouts, with label and url: of those at their commit and, unless pinned_only, of the unpinned ones.

    Contents are joined where they are: only the list goes to the files."""
    right = checkouts(spark, corpora, root).where(F.col("status").isin(["ok"] if pinned_only else ["ok", "unpinned"]))
    chosen = right.select(F.col("folder").alias("__folder"), "label", "url")
    files = read_files(spark, root, extensions)
    return files.join(chosen, F.col("package") == F.col("__folder")).drop("__folder")


def _texts(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """path, text of small files; patterns that match nothing are passed over."""
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in patterns]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p, a in zip(patterns, at) if any(s.isFile() for s in a.getFileSystem(conf).globStatus(a) or [])]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.format("binaryFile").load(there).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
