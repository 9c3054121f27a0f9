"""Streams over landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def first_by_hash(spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The smallest key of each text's hash, by a stream over the files of a folder, read when all of them are in.

    The stream has no state: each micro-batch writes its own minima, one row for each of its hashes, and the reader takes the
    least of them."""
    schema = spark.read.parquet(folder).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    stream = spark.readStream.schema(schema)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        # a stream watches folders: a single file is picked out of its own
        stream, folder = stream.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = stream.parquet(folder).select(F.col(key), F.sha2(text, 256).alias("hash"))
    out, marks = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-marks")

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is tried again overwrites itself
        batch.groupBy("hash").agg(F.min(key).alias(key)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run = rows.writeStream.foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(f"hash string, {key} {schema[key].dataType.simpleString()}").parquet(f"{out}/batch=*")
    return found.groupBy("hash").agg(F.min(key).alias(key))


def dedupe_stream(rows: DataFrame, hash_column: str, event_time: str, within: str) -> DataFrame:
    """The first row of each hash within a time: state is dropped behind the watermark."""
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark([hash_column])


def verdict_stream(rows: DataFrame, event_time: str, package: str, score: str, threshold: float, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Flagged objects by package and window of event time."""
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, window), package).agg(F.count("*").alias("objects"), F.sum((F.col(score) > threshold).cast("long")).alias("flagged"))


VERDICT = "package string, files long, flagged long, verdict string, amended boolean"


def findings_stream(files: DataFrame, package: str = "package", path: str = "path", flagged: str = "flagged", total: str = "total", event_time: str = "ts", wait: str = "10 minutes", quiet_seconds: int = 600, keep_seconds: int = 86_400) -> DataFrame:
    """A verdict (VERDICT) for each package of a stream of scanned files (package, path, flagged objects, files in the package, time).

    It is sent once: when all files of the package are in, or when event time has passed the last one by quiet_seconds. A file that
    comes later amends it, if it changes the verdict. A file that comes twice counts once. keep_seconds after its last file a package
    is forgotten."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        seen, n, bad, due, sent, last = state.get if state.exists else ([], 0, 0, 0, "", 0)
        out = []
        if state.hasTimedOut:
            if sent:
                state.remove()
                return
            sent = "malicious" if bad else "good"
            out.append((key[0], n, bad, sent, False))
        else:
            known = set(seen)
            for rows in batches:
                for p, f, t, at in zip(rows["p"], rows["f"], rows["t"], rows["at"]):
                    last, due = max(last, int(at)), max(due, int(t))
                    if p not in known:
                        known.add(p)
                        n, bad = n + 1, bad + int(f)
            seen = list(known)
            now = "malicious" if bad else "good"
            if sent and now != sent or not sent and n >= due > 0:
                out.append((key[0], n, bad, now, bool(sent)))
                sent = now
        state.update((seen, n, bad, due, sent, last))
        state.setTimeoutTimestamp(max((last + (keep_seconds if sent else quiet_seconds)) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["package", "files", "flagged", "verdict", "amended"])

    rows = files.withWatermark(event_time, wait).select(
        F.col(package).alias("k"), F.xxhash64(path).alias("p"), F.coalesce(F.col(flagged).cast("long"), F.lit(0)).alias("f"), F.coalesce(F.col(total).cast("long"), F.lit(0)).alias("t"), F.unix_seconds(event_time).alias("at"), event_time
    )
    return rows.groupBy("k").applyInPandasWithState(step, VERDICT, "seen array<bigint>, n long, bad long, due long, sent string, last long", "append", GroupStateTimeout.EventTimeTimeout)
