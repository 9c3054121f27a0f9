"""A session with the settings that the jobs count on; what a cluster sets is left alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sieveline", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of files for each core up to which rows are dealt anew: beyond, every core has several splits of the usual 128 MB.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its files are too few or small for that: work on each row that takes long would be one task's else.

    Large inputs stay as they are; what decides is the optimiser's estimate, so nothing is read for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES * cores else df


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, local masters get a folder of their own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, made: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and lost executors cost no recomputation. The path goes to `made`, for drop_paths()."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of intermediate results that nothing reads any more, through the Hadoop file system."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()
