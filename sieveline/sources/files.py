"""Files as rows, and archives as files."""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

#: Archives are untrusted: all that comes out of one may have so many bytes, or so many times its own, whichever is more. An archive
#: inside counts as so many bytes at least, which bounds the depth. Members come in pieces of about PIECE_BYTES, cut between lines.
ARCHIVE_BYTES, ARCHIVE_RATIO, NESTED_BYTES, PIECE_BYTES = 1 << 30, 200, 4 << 20, 16 << 20


def with_extension(rows: DataFrame, path: str) -> DataFrame:
    """rows with extension: lower case, without its dot, empty if there is none."""
    return rows.withColumn("extension", F.lower(F.regexp_extract(path, r"[.]([^./]*)$", 1)))


def accepted(extension: Column, extensions: list[str] | None = None) -> Column:
    wanted = [e.lower().lstrip(".") for e in (extensions or fixed.LANGUAGES)]
    return F.coalesce(extension.isin(wanted), F.lit(False))


def language(extension: Column, default: str | None = "python") -> Column:
    out = F.when(extension == "py", "python")
    for e, lang in fixed.LANGUAGES.items():
        out = out.when(extension == e, lang)
    return out.otherwise(F.lit(default).cast("string"))


def file_types(rows: DataFrame, package: str) -> DataFrame:
    return rows.groupBy(package).agg(F.array_sort(F.collect_set(F.when(F.col("extension") != "", F.col("extension")))).alias("types"))


def read_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, content: bool = True) -> DataFrame:
    """path, package (the first folder below), extension, size, accepted, language and the text of accepted files: UTF-8 with replacement.

    A folder that doesn't exist gives no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, package string, extension string, size long, accepted boolean, language string" + ", text string" * content)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = with_extension(rows.select("path", F.col("length").alias("size"), "content"), "path")
    rows = rows.withColumn("accepted", accepted(F.col("extension"), extensions)).withColumn("language", language(F.col("extension")))
    below = F.regexp_extract("path", "/" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/([^/]+)/", 1)
    rows = rows.withColumn("package", F.coalesce(F.nullif(below, F.lit("")), F.lit(".")))
    out = ["path", "package", "extension", "size", "accepted", "language"]
    return rows.select(*out, F.when(F.col("accepted"), F.make_valid_utf8(F.col("content").cast("string"))).alias("text")) if content else rows.select(*out)


def read_dictionary(spark: SparkSession, path: str, limit: int = 8 << 20) -> dict[str, dict[str, str]]:
    """A JSON dictionary of names and categories by language, as the library has in its fixed values; its size is checked, as all tasks get it."""
    raw = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit).select("content").first()
    if raw is None:
        raise ValueError(f"no dictionary of at most {limit} bytes: {path}")
    return {language: {str(name): str(category) for name, category in table.items()} for language, table in json.loads(bytes(raw["content"])).items()}


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """tokens, hash, language, filepath; fields of any length and with line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1, schema="tokens string, hash string, language string, filepath string")


class Budget:
    """Bytes that may still come out of an archive."""

    def __init__(self, left: int):
        self.left = left

    def take(self, size: int) -> bool:
        """Whether so many bytes may come; if so, they are spent."""
        if size > self.left:
            return False
        self.left -= size
        return True


def members(name: str, data: bytes, password: bytes | None = None, budget: Budget | None = None, member_bytes: int | None = None) -> Iterator[tuple[str, int, object]]:
    """(name, size, open file) of the files of a zip, wheel or tar archive; None in place of the file beyond the limits. A file is to be read before the next one is asked for.

    A zip's directory tells where its members are; a tar is read as it comes. Links, devices and names that leave the archive are
    passed over."""
    budget = budget or Budget(max(ARCHIVE_BYTES, ARCHIVE_RATIO * len(data)))

    def fits(size: int) -> bool:
        return (member_bytes is None or size <= member_bytes) and budget.take(size)

    if name.endswith((".whl", ".zip")):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and safe(info.filename):
                    yield info.filename, info.file_size, z.open(info, pwd=password) if fits(info.file_size) else None
    elif name.endswith((".tgz", ".tar", ".gz", ".bz2", ".xz")) and (".tar" in name or name.endswith(".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as t:
            for info in t:
                if info.isfile() and safe(info.name):
                    yield info.name, info.size, t.extractfile(info) if fits(info.size) else None
    elif name.endswith(".gz"):
        import gzip

        # the size isn't stated: it is counted first
        size, most = 0, budget.left if member_bytes is None else min(budget.left, member_bytes)
        with gzip.open(io.BytesIO(data)) as g:
            while size <= most and (part := g.read(1 << 20)):
                size += len(part)
        yield name.rsplit("/", 1)[-1].removesuffix(".gz"), size, gzip.open(io.BytesIO(data)) if fits(size) else None
    else:
        raise ValueError(f"no archive that is known: {name}")


def pieces(file, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A file's content in pieces of about a size that end with a line, as far as lines allow; at least one."""
    held, first = b"", True
    while part := file.read(size):
        held += part
        while len(held) > size:
            cut = held.rfind(b"\n", 0, size) + 1 or size
            while cut < len(held) and held[cut] & 0xC0 == 0x80:  # not within a character
                cut -= 1
            yield held[:cut]
            held, first = held[cut:], False
    if held or first:
        yield held


def safe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def read_archives(spark: SparkSession, folder: str, extensions: list[str] | None = None, refused: bool = True, **limits) -> DataFrame:
    """archive_members() of all files below a folder."""
    return archive_members(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), extensions, refused, **limits)


def archive_members(files: DataFrame, extensions: list[str] | None = None, refused: bool = True, nested: int | None = None, password: bytes | None = None, member_bytes: int | None = None, archive_bytes: int | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """path (archive!member), package (the archive's name), extension, size, language, text and warnings of the accepted members of archives (path, content).

    Members of any size are read, in pieces of about piece_bytes (a further piece's path ends with # and its number), and archives
    inside archives at any depth, as long as all of it stays within ARCHIVE_BYTES or ARCHIVE_RATIO times the archive. What isn't read
    has a row without text and a warning: MALFORMED_FILE for broken archives, PATHOLOGICAL_FILE beyond that, and beyond the limits
    nested, member_bytes and archive_bytes, if given; so nothing is hidden behind padding. refused=False leaves these rows and the
    column out."""
    wanted = {e.lower().lstrip(".") for e in (extensions or fixed.LANGUAGES)}
    endings = (".zip", ".whl", ".tgz", ".tar", ".gz", ".tar.bz2", ".tar.xz")
    broken = (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, RuntimeError, zlib.error, NotImplementedError, struct.error)

    def extension(inner: str) -> str:
        last = inner.rsplit("/", 1)[-1]
        return last.rsplit(".", 1)[-1].lower() if "." in last else ""

    def walk(name: str, data: bytes, depth: int | None, budget: Budget):
        """(path below, size, content, warning)"""
        try:
            for inner, size, file in members(name, data, password, budget, member_bytes):
                if file is None:
                    yield inner, size, None, "PATHOLOGICAL_FILE"
                elif inner.endswith(endings):
                    if depth == 0 or not budget.take(max(NESTED_BYTES - size, 0) if archive_bytes is None else 0):
                        yield inner, size, None, "PATHOLOGICAL_FILE"
                        continue
                    for below, n, content, warning in walk(inner, file.read(), None if depth is None else depth - 1, budget):
                        yield f"{inner}!{below}" if below else inner, n, content, warning
                elif extension(inner) in wanted:
                    for number, piece in enumerate(pieces(file, piece_bytes)):
                        yield f"{inner}#{number}" if number else inner, size, piece, None
        except broken:
            yield "", len(data), None, "MALFORMED_FILE"

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                data = content.as_py()
                for inner, size, body, warning in walk(path, data, nested, Budget(max(ARCHIVE_BYTES, ARCHIVE_RATIO * len(data)) if archive_bytes is None else archive_bytes)):
                    ext = extension(inner.rsplit("#", 1)[0] if body is not None else inner)
                    whole = not inner or inner.endswith(endings)
                    if (warning and refused and (whole or ext in wanted)) or not warning:
                        text = body.decode("utf-8", "replace").replace("\x00", "") if body is not None else None
                        rows.append((f"{path}!{inner}" if inner else path, path.rsplit("/", 1)[-1], ext, size, fixed.LANGUAGES.get(ext, "python"), text, [warning] if warning else []))
                        held += len(text or "")
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "package", "extension", "size", "language", "text", "warnings"])

    found = files.select("path", "content").mapInArrow(run, "path string, package string, extension string, size long, language string, text string, warnings array<string>")
    return found if refused else found.drop("warnings")
