"""Shards under size-tiered compaction, with a versioned manifest. DataFrame operations only.

Arrivals are appended as small immutable files, without a shuffle. Compaction merges files of the same size tier into files
of about the target size, also without a shuffle, and leaves what is large enough alone. A version of the table is a
manifest: a list of files. A version comes into being when its pointer, written whole under another name, is renamed to the
version's number, which must not exist: readers see either the old or the new version, a writer that dies leaves no version,
and of two writers one loses, rebuilds its change on the newer version and tries again.

What the store must grant: a rename that is atomic and fails where the target exists (HDFS and its like; a local file system
checks before it renames, which is enough for one writer at a time). Stores that only copy need a folder of another kind
for `versions`.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import shared_dir

#: Rows of an arriving shard; bytes of a merged file; files of a tier that make a merge worthwhile, also the ratio of tiers.
ARRIVAL_ROWS = 1024
TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Files of one merge job: bounds the paths that the driver holds at a time.
JOB_FILES = 10_000
#: Times that a writer rebuilds its change on a newer version.
ATTEMPTS = 10

ENTRY = "path string, bytes long, rows long"


class Conflict(RuntimeError):
    """Another writer has committed the version, or has taken away files that this one merged."""


class ShardTable:
    """A table of shards under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_dir(spark, "shards")).rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def latest(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, rows of the files of a version (the latest by default)."""
        version = self.latest() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], ENTRY)
        stream = self._fs.open(self._path(f"{self.root}/versions/{version}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifests/{name}")

    def commit(self, entries: DataFrame, base: int) -> int:
        """Write the manifest and bring version base + 1 into being, which must not exist (Conflict)."""
        name = f"{base + 1}-{uuid.uuid4().hex}"
        entries.select("path", "bytes", "rows").coalesce(1 if base == 0 else 4).write.parquet(f"{self.root}/manifests/{name}")
        whole = self._path(f"{self.root}/versions/.{name}")
        stream = self._fs.create(whole, False)
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        if not self._renamed(whole, self._path(f"{self.root}/versions/{base + 1}")):
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def _renamed(self, whole, target) -> bool:
        """Rename a file that is written to a name that must not exist; False, and the file is gone, if it does."""
        fs = self._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(whole.toUri(), self._conf).rename(whole, target, how)
        except Py4JJavaError as error:
            self._fs.delete(whole, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def _change(self, added: DataFrame, removed: DataFrame | None = None) -> int:
        """Commit the latest version without `removed` and with `added`; on a conflict again, on the then latest version."""
        for _ in range(ATTEMPTS):
            base = self.latest()
            entries = self.manifest(base)
            if removed is not None:
                if removed.join(entries, "path", "left_anti").limit(1).count():
                    raise Conflict("files that were merged are no longer in the table")
                entries = entries.join(removed, "path", "left_anti")
            try:
                return self.commit(entries.select("path", "bytes", "rows").unionByName(added), base)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts lost against other writers")

    def _files(self, folder: str) -> DataFrame:
        """path, bytes, rows of the data files in a folder, from Spark's file metadata."""
        # a column that no file has: nothing but the metadata is read, whatever the data's columns are called
        meta = F.col("_metadata")
        files = self.spark.read.schema(f"none_{uuid.uuid4().hex} int").parquet(folder)
        return files.groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Write rows as small shards as they come and commit them on top of the latest version.

        Nulls, repeated rows, very long texts and columns of any name are kept as they are. Empty input commits a version
        without new files. Further columns are added to the table (null in the rows before); columns that lack are null; a column
        of another type than the table's is a ValueError, before anything is written."""
        self._add_columns(rows.schema)
        folder = f"{self.root}/data/append-{_unique()}"
        rows.write.option("maxRecordsPerFile", arrival_rows).parquet(folder)
        return self._change(self._files(folder))

    def _schemas(self) -> list[int]:
        folder = self._path(f"{self.root}/schemas")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _add_columns(self, own: StructType) -> None:
        """Bring a schema with the columns of `own` into being, unless they are there. Schemas are numbered and never changed: of two
        writers one creates the next number, the other looks again."""
        for _ in range(ATTEMPTS):
            have = self._schemas()
            known = self.schema() if have else StructType()
            types = {f.name: f.dataType for f in known}
            for f in own:
                if types.get(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"column {f.name} is {types[f.name].simpleString()} in the table, not {f.dataType.simpleString()}")
            more = [StructField(f.name, f.dataType, True) for f in own if f.name not in types]
            if have and not more:
                return
            number = (have[-1] if have else 0) + 1
            whole = self._path(f"{self.root}/schemas/.{number}-{uuid.uuid4().hex}")
            stream = self._fs.create(whole, False)
            stream.write(bytearray(StructType([*known.fields, *more]).json().encode()))
            stream.close()
            if self._renamed(whole, self._path(f"{self.root}/schemas/{number}")):
                return
        raise Conflict(f"{ATTEMPTS} attempts lost against other writers")

    def schema(self) -> StructType:
        """The columns of the table: those of all appends."""
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schemas/{self._schemas()[-1]}", wholetext=True).first()[0]))

    def tiers(self, entries: DataFrame, target: int, fan_in: int) -> DataFrame:
        """entries with their tier: sizes within a factor fan_in of each other are of a tier; files of half the target and more have none (null)."""
        return entries.withColumn("tier", F.when(F.col("bytes") < target // 2, F.floor(F.log(float(fan_in), F.greatest("bytes", F.lit(1)).cast("double"))).cast("int")))

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, job_files: int = JOB_FILES) -> int:
        """Merge each tier that has at least fan_in files into files of about the target size, and commit.

        A merge job takes about job_files files; tiers with more are merged by several jobs. No merge, no new version."""
        base = self.latest()
        entries = self.tiers(self.manifest(base), target, fan_in)
        counts = entries.where("tier IS NOT NULL").groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= fan_in).orderBy("tier").collect()
        if not counts:
            return base
        schema, added = self.schema(), self.spark.createDataFrame([], ENTRY)
        for row in counts:
            own = entries.where(F.col("tier") == row["tier"])
            jobs = -(-row["n"] // job_files)
            for job in range(jobs):
                part = own.where(F.pmod(F.xxhash64("path"), F.lit(jobs)) == job).select("path").orderBy("path").collect()
                if part:
                    folder = f"{self.root}/data/merge-{_unique()}"
                    self._merge_job([p["path"] for p in part], target, schema, folder)
                    added = added.unionByName(self._files(folder))
        return self._change(added, entries.where(F.col("tier").isin([row["tier"] for row in counts])).select("path"))

    def _merge_job(self, paths: list[str], target: int, schema: StructType, folder: str) -> None:
        # In a session of its own the reader packs whole files into partitions of up to the target, however small the input
        # is for the cluster; each partition becomes a file, without a shuffle.
        own = self.spark.newSession()
        for name, value in (("maxPartitionBytes", target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            own.conf.set(f"spark.sql.files.{name}", str(value))
        own.read.schema(schema).parquet(*paths).write.parquet(folder)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. The driver holds the list of its files, as for any table of files in Spark."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema()) if self._schemas() else self.spark.createDataFrame([], "doc_id long")
        return self.spark.read.schema(self.schema()).parquet(*paths)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the latest `keep` versions lists; how many. Not while another writer is at work: its files aren't listed yet."""
        have = self.versions()
        live = {self._path(r["path"]).toUri().getPath() for v in have[-keep:] for r in self.manifest(v).select("path").toLocalIterator()}
        gone, walk = 0, self._fs.listFiles(self._path(f"{self.root}/data"), True)
        doomed = []
        while walk.hasNext():
            f = walk.next().getPath()
            if f.getName().endswith(".parquet") and f.toUri().getPath() not in live:
                doomed.append(f)
        for f in doomed:
            gone += bool(self._fs.delete(f, False))
        return gone


def _unique() -> str:
    return uuid.uuid4().hex[:12]
