"""Roll-ups of scored objects by package, as one job for any number of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def flagged(score: Column, threshold: float = fixed.THRESHOLD) -> Column:
    """Strictly above the threshold; a missing score isn't."""
    return F.coalesce(score > threshold, F.lit(False))


def verdict(malicious: Column, n_flagged: Column) -> Column:
    return F.when(malicious, "malicious").when(n_flagged > 0, "suspicious").otherwise("good")


def package_verdict(objects: DataFrame, package: str, score: str, threshold: float = fixed.THRESHOLD, malicious: Column | None = None) -> DataFrame:
    """package, objects, flagged, confidence (mean score of the flagged, 1 without any), verdict.

    malicious: a condition on these columns, by default that any object is flagged; packages with flagged objects that don't
    meet it are suspicious."""
    f = flagged(F.col(score), threshold)
    agg = objects.groupBy(package).agg(F.count("*").alias("objects"), F.sum(f.cast("long")).alias("flagged"), F.avg(F.when(f, F.col(score))).alias("__c"))
    out = agg.select(package, "objects", "flagged", F.coalesce("__c", F.lit(1.0)).alias("confidence"))
    return out.withColumn("verdict", verdict(F.col("flagged") > 0 if malicious is None else malicious, F.col("flagged")))


def package_stats(files: DataFrame, objects: DataFrame, package: str, accepted: str, extension: str, score: str, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """package, total_files, skipped_files, processed_files, file_types (sorted), processed_objects, flagged_objects."""
    f = files.groupBy(package).agg(
        F.count("*").alias("total_files"), F.sum((~F.col(accepted)).cast("long")).alias("skipped_files"), F.sum(F.col(accepted).cast("long")).alias("processed_files"),
        F.array_sort(F.collect_set(F.when(F.col(extension) != "", F.lower(extension)))).alias("file_types"),
    )
    o = objects.groupBy(package).agg(F.count("*").alias("processed_objects"), F.sum(flagged(F.col(score), threshold).cast("long")).alias("flagged_objects"))
    return f.join(o, package, "left").fillna(0, ["processed_objects", "flagged_objects"])


def categories(language: Column, functions=None) -> Column:
    """Function categories of a language, as an array."""
    functions = fixed.FUNCTION_MAP if functions is None else functions
    out = F.array().cast("array<string>")
    for lang, table in functions.items():
        out = F.when(language == lang, F.array(*[F.lit(x) for x in sorted(set(table.values()))])).otherwise(out)
    return out


def object_activities(tokens: Column, language: Column, functions=None) -> Column:
    """Distinct function categories among an object's tokens, sorted."""
    return F.array_sort(F.array_intersect(tokens, categories(language, functions)))


def activities(objects: DataFrame, package: str, activity_list: str, score: str, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """package, activity of the flagged objects, once each."""
    return objects.where(flagged(F.col(score), threshold)).select(package, F.explode(activity_list).alias("activity")).distinct()


def findings_by_file(objects: DataFrame, package: str, path: str, name: str, score: str, order: str, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """package, path, names of the flagged objects in order. A group holds the objects of one file."""
    found = objects.where(flagged(F.col(score), threshold)).groupBy(package, path).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("__o"))
    return found.select(package, path, F.transform("__o", lambda s: s["n"]).alias("names"))
