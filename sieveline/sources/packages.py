"""Packages from an index: their metadata as a batch source, the newest ones as a stream, and their archives as files.

Both sources are Spark data sources in Python: `register(spark)` makes the formats `package_index` and `package_feed` known. Addresses
are templates, so an index can be a server (https://.../pypi/{name}/json) or a mirror in a folder (file:///mirror/{name}.json)."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

#: Kinds of downloads that are scanned.
KINDS = ("sdist", "bdist_wheel")
RELEASE = "name string, version string, latest boolean, url string, filename string, packagetype string, size long, status string, message string"


def fetched(address: str, retries: int = 3, wait: float = 1.0, timeout: float = 30.0) -> bytes:
    """What an address holds. Other failures than "not found" are tried again, each time after twice the wait; FileNotFoundError if it isn't there."""
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(address, timeout=timeout) as response:
                return response.read()
        except urllib.error.HTTPError as error:
            if error.code in (404, 410):
                raise FileNotFoundError(address) from error
            if not left or error.code in (400, 401, 403):
                raise
        except (urllib.error.URLError, OSError) as error:
            if isinstance(getattr(error, "reason", error), FileNotFoundError):
                raise FileNotFoundError(address) from error
            if not left:
                raise
        time.sleep(wait * 2 ** (retries - left))
    raise AssertionError


def releases(name: str, document: dict, every: bool = False) -> Iterator[tuple]:
    """Rows (RELEASE) of a package's metadata: downloads of the latest version, or of every one. One row with a status if there are none."""
    info, found = document.get("info") or {}, document.get("releases") or {}
    latest = info.get("version")
    if latest is None and not every:
        yield name, None, None, None, None, None, None, "error", "no version is stated"
        return
    any_ = False
    for version in sorted(found) if every else [latest]:
        downloads = found.get(version) or (document.get("urls") if version == latest else None) or []
        for d in downloads:
            if d.get("packagetype") in KINDS:
                any_ = True
                yield name, version, version == latest, d.get("url"), d.get("filename"), d["packagetype"], d.get("size"), "ok", None
    if not any_:
        yield name, latest, True if latest else None, None, None, None, None, "empty", "no download of a known kind"


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _IndexReader(DataSourceReader):
    """Reads the metadata of names; conditions on the name are taken over, so that only what is asked for is fetched."""

    def __init__(self, options: dict):
        self.address, self.every = options["address"], options.get("every", "false").lower() == "true"
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 1.0))
        self.each = int(options.get("namesPerPartition", 50))
        self.names = sorted({n.strip() for n in options.get("names", "").split(",") if n.strip()})
        self.listing = options.get("listing")
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and tuple(f.attribute) == ("name",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def chosen(self) -> list[str]:
        """The names to fetch: those of the conditions if there are any, else those of the option, else those that the index lists."""
        if self.names or self.wanted is None:
            names = self.names or (listed(fetched(self.listing, self.retries, self.wait).decode()) if self.listing else [])
            return [n for n in names if self.wanted is None or n in self.wanted]
        return sorted(n for n in self.wanted if n)

    def partitions(self):
        names = self.chosen()
        return [_Names(names[i : i + self.each]) for i in range(0, len(names), self.each)]

    def read(self, partition):
        for name in partition.names if partition is not None else []:
            try:
                yield from releases(name, json.loads(fetched(self.address.replace("{name}", quote(name, safe="")), self.retries, self.wait)), self.every)
            except FileNotFoundError:
                yield name, None, None, None, None, None, None, "not_found", None
            except Exception as error:  # one package's failure isn't the job's
                yield name, None, None, None, None, None, None, "error", str(error)


def listed(page: str) -> list[str]:
    """Names that an index's simple page links to."""
    return sorted({n.strip() for n in re.findall(r"<a\b[^>]*>([^<]+)</a>", page) if n.strip()})


class PackageIndex(DataSource):
    """Format package_index. Options: address (template with {name}), names (comma-separated) or listing (address of the page with all
    names), every (all versions, not the latest only), retries, wait, namesPerPartition. Rows: RELEASE; packages that aren't there, have
    no downloads or fail are rows with that status."""

    @classmethod
    def name(cls) -> str:
        return "package_index"

    def schema(self) -> str:
        return RELEASE

    def reader(self, schema):
        return _IndexReader(self.options)


class _Range(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _FeedReader(DataSourceStreamReader):
    """Offsets count snapshots. Each look at the feed that shows something new is stored as a snapshot before its offset is given out, so a
    batch that is tried again, also after a restart, reads what it read before."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.feed, self.retries, self.wait = options["feed"], int(options.get("retries", 3)), float(options.get("wait", 1.0))
        where = options["snapshots"].rstrip("/")
        self.fs, self.path = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        self.fs.create_dir(self.path, recursive=True)

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path))
        return sorted(int(i.base_name[:-5]) for i in found if re.fullmatch(r"\d{9}[.]json", i.base_name))

    def _read(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.path}/{number:09}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        shown = feed_items(fetched(self.feed, self.retries, self.wait))
        before = {tuple(x[:2]) for x in self._read(last)["shown"]} if last else set()
        new = [x for x in shown if tuple(x[:2]) not in before]
        if new:
            last += 1
            with self.fs.open_output_stream(f"{self.path}/.{last:09}") as f:
                f.write(json.dumps({"shown": shown, "new": new}).encode())
            self.fs.move(f"{self.path}/.{last:09}", f"{self.path}/{last:09}.json")
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict):
        return [_Range(n) for n in range(start["snapshot"] + 1, end["snapshot"] + 1)]

    def read(self, partition):
        for name, version, published in self._read(partition.number)["new"]:
            yield name, version, published, partition.number

    def commit(self, end: dict) -> None:
        """Snapshots before the last committed one aren't needed any more."""
        for number in self._numbers():
            if number < end["snapshot"]:
                self.fs.delete_file(f"{self.path}/{number:09}.json")

    # a reader travels to the workers
    def __getstate__(self):
        return self.__dict__


def feed_items(page: bytes) -> list[list]:
    """[name, version, published] of a feed's items, the oldest first. Titles are "name version"; an item without a name is passed over, and a repeated one counts once."""
    out, seen = [], set()
    for item in ElementTree.fromstring(page).iter("item"):
        words = (item.findtext("title") or "").split()
        if words and tuple(words[:2]) not in seen:
            seen.add(tuple(words[:2]))
            out.append([words[0], words[1] if len(words) > 1 else None, item.findtext("pubDate")])
    return out[::-1]


class PackageFeed(DataSource):
    """Format package_feed, a stream. Options: feed (address of the RSS page of the newest packages), snapshots (a folder that all
    workers share, of any file system that Arrow knows), retries, wait. Rows: name, version, published, snapshot; each item of the feed
    once, as long as looks at the feed overlap."""

    @classmethod
    def name(cls) -> str:
        return "package_feed"

    def schema(self) -> str:
        return "name string, version string, published string, snapshot long"

    def streamReader(self, schema):
        return _FeedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let conditions reach the index."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageIndex)
    spark.dataSource.register(PackageFeed)


def package_releases(spark: SparkSession, address: str, names: list[str] | None = None, version: str | None = None, **options) -> DataFrame:
    """Downloads (RELEASE) of packages: of the latest version, or of one that is named."""
    register(spark)
    reader = spark.read.format("package_index").option("address", address).options(**options)
    if version is not None:
        reader = reader.option("every", "true")
    rows = (reader.option("names", ",".join(names)) if names is not None else reader).load()
    return rows if version is None else rows.where((F.col("version") == version) | (F.col("status") != "ok"))


def fetch_archives(rows: DataFrame, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """name, version, path (the file's name), content and message of downloads (name, version, url, filename), fetched by the tasks.

    A download that fails has no content but a message. Rows without an address are passed over; equal addresses are fetched once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                content, message = None, None
                try:
                    content = fetched(row["url"], retries, wait)
                except Exception as error:
                    message = str(error) or type(error).__name__
                name = row["filename"] or urlsplit(row["url"]).path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_pylist([{"name": row["name"], "version": row["version"], "path": name, "content": content, "message": message}], shape)

    shape = pa.schema([("name", pa.string()), ("version", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("message", pa.string())])
    some = rows.where("url IS NOT NULL").select("name", "version", "url", "filename").dropDuplicates(["url"])
    return some.mapInArrow(run, "name string, version string, path string, content binary, message string")
