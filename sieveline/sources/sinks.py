"""Sinks: training sets, routed folders, copies of flagged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, triage


def write_training(rows: DataFrame, path: str, form: str = "parquet", mode: str = "append") -> None:
    """tokens, hash, language, filepath as Parquet, or as CSV with a header for parity; appending is the default."""
    out = rows.select("tokens", "hash", "language", "filepath").write.mode(mode)
    out.option("header", True).option("escape", '"').csv(path) if form == "csv" else out.parquet(path)


def write_processed(benign: DataFrame, malicious: DataFrame, key: str, order: list, path: str) -> None:
    """Both classes without repeats and shared rows, as one table partitioned by label."""
    dataset.label_union(*dataset.benign_wins(benign, malicious, key, order)).write.mode("overwrite").partitionBy("label").parquet(path)


def route(files: DataFrame, decisions: DataFrame, group: str, decision: str, path: str) -> None:
    """Files under the decision on their group; without one they are suspicious."""
    d = decisions.select(F.col(group).alias("__g"), F.col(decision).alias("__d"))
    joined = files.join(d, F.col(group).eqNullSafe(F.col("__g")), "left")
    joined.withColumn("decision", F.coalesce("__d", F.lit("suspicious"))).drop("__g", "__d").write.mode("overwrite").partitionBy("decision").parquet(path)


def write_extracts(extracts: DataFrame, name: str, text: str, order: str, path: str) -> None:
    """Extracts with unique names, escaped line breaks and tabs written out."""
    plain = F.replace(F.replace(F.col(text), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    triage.unique_names(extracts.withColumn(text, plain), name, order).write.mode("overwrite").parquet(path)


def write_new(reports: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key isn't in the table yet, partitioned by it; how many."""
    spark = reports.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        reports = reports.join(spark.read.parquet(path).select(F.col(key).cast(reports.schema[key].dataType).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    n = reports.count()
    if n:
        reports.write.mode("append").partitionBy(key).parquet(path)
    return n


def concatenated(files: DataFrame, group: str, path: str, text: str) -> DataFrame:
    """One text for each group: a heading, then each file under its own banner, in order of the paths."""
    part = F.concat(F.lit("\n" + "=" * 80 + "\nFile: "), F.col(path), F.lit("\n" + "=" * 80 + "\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), part.alias("t"))))
    return files.groupBy(group).agg(listed.alias("__p"), F.count("*").alias("n")).select(group, F.concat(F.lit("Flagged files: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("__p", lambda s: s["t"]), "")).alias("text"))


def copy_files(spark: SparkSession, paths: DataFrame, path: str, root: str, target: str) -> int:
    """Copy the files named in a column to a folder, at the same place below it as they have below root; how many.

    Paths come to the driver one by one, the copies are made by the file systems: for the flagged files of a package, which
    are for a person's reading. Files that aren't below root, and members of archives, are passed over."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    plain = lambda p: fs.Path(p).toUri().getPath()
    base, n = plain(root).rstrip("/") + "/", 0
    for row in paths.select(F.col(path).alias("p")).where("p IS NOT NULL").distinct().toLocalIterator():
        place = plain(row["p"])
        if not place.startswith(base):
            continue
        source, out = fs.Path(row["p"]), fs.Path(f"{target.rstrip('/')}/{place[len(base):]}")
        own, other = source.getFileSystem(conf), out.getFileSystem(conf)
        if own.exists(source):
            other.mkdirs(out.getParent())
            n += bool(fs.FileUtil.copy(own, source, other, out, False, conf))
    return n
