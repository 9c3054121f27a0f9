"""Whole jobs: scanning packages, preparing training sets, training, triage."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dataset, objects, report, scoring, triage, windows
from ..operators.compile import compile_files
from ..operators.render import Report, render_packages
from ..session import written
from ..sources import files as sources
from ..sources import packages


def compiled(files: DataFrame, functions=None, imports=None) -> DataFrame:
    """Objects with tokens and hashes of the accepted files; functions and imports are dictionaries by language, the library's own by default."""
    accepted = files.where("accepted") if "accepted" in files.columns else files
    return objects.with_tokens(compile_files(accepted, content="text", size="size", carry=["package"], warnings="warnings" if "warnings" in files.columns else None), functions, imports)


def score_objects(rows: DataFrame, scorer: Callable[[list[str]], list[float]] | None = None, weights: dict[str, float] | None = None, functions=None) -> DataFrame:
    """rows with score and embedding_count. Objects that pass the gate are scored window by window, the largest counts; others have none.

    The gate comes first, so only what passes it reaches an external scorer."""
    rows = rows.withColumn("embedding_count", F.size("tokens")).withColumn("__gate", objects.gate(F.col("token_string"), F.col("language"), functions))
    if scorer is None:
        windowed = F.transform(windows.starts(F.size("tokens")), lambda s: scoring.linear_score(F.slice("tokens", s + 1, fixed.WINDOW), weights))
        return rows.withColumn("score", F.when(F.col("__gate"), F.array_max(windowed))).drop("__gate")
    key = ["package", "file_path", "name", "hash"]
    each = windows.windows(rows.where("__gate"), "tokens", carry=key).withColumn("__text", F.array_join("window", " "))
    best = windows.best_window(scoring.external_score(each, "__text", scorer), key, "score", "window_index").select(*[F.col(k).alias(f"__{k}") for k in key], "score")
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return rows.join(best, match, "left").drop(*[f"__{k}" for k in key], "__gate")


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, threshold: float = fixed.THRESHOLD, scorer=None, archives: bool = False, functions=None, imports=None) -> tuple[DataFrame, DataFrame]:
    """(files, scored objects) of all packages below a folder, as one job."""
    files = sources.read_archives(spark, folder, extensions, refused=True).withColumn("accepted", F.lit(True)) if archives else sources.read_files(spark, folder, extensions)
    found = score_objects(compiled(files, functions, imports), scorer, functions=functions)
    return files, found.withColumn("activities", report.object_activities(F.col("tokens"), F.col("language"))).withColumn("flagged", report.flagged(F.col("score"), threshold))


def scan_packages(spark: SparkSession, address: str, names: list[str], version: str | None = None, extensions: list[str] | None = None, threshold: float = fixed.THRESHOLD, scorer=None, functions=None, imports=None, **options) -> tuple[DataFrame, DataFrame]:
    """(downloads, scored objects) of packages of an index, as one job: metadata, archives, members, objects. The package of an object is its name in the index.

    Packages that aren't there and downloads that fail are in the first table, with a status or message; they have no objects."""
    found = packages.package_releases(spark, address, names, version, **options)
    content = written(packages.fetch_archives(found), "downloads")
    files = sources.archive_members(content.where("content IS NOT NULL"), extensions)
    of = content.select(F.col("path").alias("package"), F.col("name").alias("__name")).dropDuplicates(["package"])
    files = files.join(of, "package").drop("package").withColumnRenamed("__name", "package").withColumn("accepted", F.lit(True))
    objects_ = score_objects(compiled(files, functions, imports), scorer, functions=functions).withColumn("flagged", report.flagged(F.col("score"), threshold))
    downloads = found.select("name", "version", "filename", "status", F.col("message").alias("__m")).join(content.select(F.col("path").alias("filename"), F.col("name"), F.col("message").alias("__d")), ["name", "filename"], "left")
    failed = F.col("__d").isNotNull()
    return downloads.select("name", "version", "filename", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), F.coalesce("__d", "__m").alias("message")), objects_


def scan_report(spark: SparkSession, folder: str, extensions: list[str] | None = None, threshold: float = fixed.THRESHOLD, scorer=None, on_finding: Callable[[dict], None] | None = None, functions=None, imports=None, form: str | None = None) -> Report:
    """The report of one package: a person's reading, on the driver. For a form that shows sources (code, tokens), or any form (None), all objects come there with theirs; for another one the flagged objects do, and the number of all."""
    began, start = time.time(), datetime.now().isoformat()
    files, found = scan(spark, folder, extensions, threshold, scorer, functions=functions, imports=imports)
    listed = files.select("path", "accepted").orderBy("path").collect()
    code, count = objects.display_code(F.col("source_code"), F.col("instructions")), None
    rows = found.select(F.col("file_path").alias("path"), "name", "score", code.alias("code"), F.col("token_string").alias("tokens"), "hash", "embedding_count", "language", "activities", F.col("source_code").alias("source"), "start", "flagged")
    if form not in (None, "code", "tokens"):
        # compiled once, for the number and the rows
        rows = written(rows, "objects")
        count, rows = rows.count(), rows.where("flagged").withColumn("source", F.lit(None).cast("string"))
    items = [r.asDict() for r in rows.drop("flagged").orderBy("path", "start", "name").toLocalIterator()]
    out = Report(folder, threshold, [r["path"] for r in listed], [r["path"] for r in listed if not r["accepted"]], items, start, time.time() - began, processed=count)
    for o in out.flagged if on_finding else []:
        on_finding(o)
    return out


def batch_verdicts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A row for each package: objects, flagged, confidence, verdict."""
    threshold = options.get("threshold", fixed.THRESHOLD)
    _, found = scan(spark, folder, **options)
    return report.package_verdict(found, "package", "score", threshold)


def batch_reports(spark: SparkSession, folder: str, out: str, form: str = "json", skip_existing: bool = True, **options) -> DataFrame:
    """Reports of all packages below a folder, as one job: a file for each, in `out`/package=NAME. Rows of what was written: package, result.

    Packages that have a report already are passed over before anything of theirs is read, if skip_existing."""
    threshold = options.get("threshold", fixed.THRESHOLD)
    files = sources.read_files(spark, folder, options.get("extensions"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if skip_existing and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        files = files.join(spark.read.text(out).select(F.col("package").cast("string").alias("package")).distinct(), "package", "left_anti")
    found = score_objects(compiled(files, options.get("functions"), options.get("imports")), options.get("scorer"), functions=options.get("functions"))
    found = found.withColumn("activities", report.object_activities(F.col("tokens"), F.col("language")))
    reports = written(render_packages(files, found, threshold, form, folder), "reports")
    reports.select("package", F.col("text").alias("value")).write.mode("append").partitionBy("package").option("lineSep", "\n").text(out)
    return reports.select("package", "result")


def training_rows(files: DataFrame) -> DataFrame:
    """tokens, hash, language, filepath of all objects; without instructions the tokens are empty."""
    return compiled(files).select(F.col("text").alias("tokens"), "hash", "language", F.col("file_path").alias("filepath"))


def preprocess(benign: DataFrame, malicious: DataFrame, path: str, by_language: bool = False) -> None:
    """Both classes of files compiled, cleaned of repeats and of malicious rows that are benign as well, written by label, or by label and language: a reader of one language then reads its folders alone."""
    good, bad = (dataset.load_rows(training_rows(f)) for f in (benign, malicious))
    dataset.label_union(*dataset.benign_wins(good, bad, "hash", ["filepath", "tokens"])).write.mode("overwrite").partitionBy("label", *["language"] * by_language).parquet(path)


def train(rows: DataFrame, ratio: float = 60.0, **options):
    """(model, metrics) of a table of tokens and label: benign rows down to a ratio, 80/20 by label, windows, logistic regression."""
    bad, good = rows.where("label = 1"), rows.where("label = 0")
    kept = dataset.downsample_ratio(good, bad, ratio, ["hash"]).unionByName(bad)
    split = dataset.stratified_split(kept, "label", "hash").withColumn("list", dataset.split_tokens(F.col("tokens")))
    each = windows.windows(split.select("label", "is_test", "list"), "list", training=True)
    model = scoring.train_logistic(each.where("NOT is_test"), "window", "label", **options)
    return model, scoring.binary_metrics(model.transform(each.where("is_test")), "label", "prediction")


def triage_folders(files: DataFrame, judge: Callable[[list[str]], list[str]], strategy: str = "concat", threshold: float = fixed.THRESHOLD, budget: int | None = None) -> DataFrame:
    """package, decision, reasoning. concat: one verdict on all of a folder's files with the judge's reasoning, or, with a budget, the severest of the verdicts on parts of so many characters; single: one for each file, rolled up; smart:
    one verdict on the extracts, which are the sources of a folder's flagged objects (folders without any are benign)."""
    if strategy == "concat" and budget:
        parts = triage.decide(triage.prompt_parts(files, "package", "path", "text", budget), "text", judge)
        return triage.severity_rollup(parts.withColumn("at", F.concat(F.lit("part "), F.col("part") + 1)), "package", "decision", "at", "part")
    if strategy == "concat":
        return triage.decide(triage.concat_by_group(files, "package", "path", "text"), "text", judge, reasoning="reasoning").select("package", "decision", "reasoning")
    if strategy == "smart":
        found = extracts(files, threshold)
        judged = triage.decide(triage.concat_by_group(found, "package", "path", "text"), "text", judge).select(F.col("package").alias("__g"), "decision")
        names = found.groupBy(F.col("package").alias("__n")).agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("reasoning"))
        whole = files.select("package").distinct().join(judged, F.col("package").eqNullSafe(F.col("__g")), "left").join(names, F.col("package").eqNullSafe(F.col("__n")), "left")
        return whole.select("package", F.coalesce("decision", F.lit("benign")).alias("decision"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
    each = triage.decide(files.select("package", "path", "text"), "text", judge)
    return triage.severity_rollup(each, "package", "decision", "path", "path")


def extracts(files: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """package, path (file and object), name, text of the flagged objects: what of a package is worth reading."""
    found = score_objects(compiled(files)).where(report.flagged(F.col("score"), threshold))
    code = objects.display_code(F.col("source_code"), F.col("instructions"))
    return found.select("package", F.concat_ws("#", "file_path", "name").alias("path"), "name", code.alias("text"))
