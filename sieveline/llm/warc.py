"""WARC archives: pages are written as records, with repeated payloads as revisits and long ones in segments, and read back.

Spark's text sink writes the archives, its binary source reads them, so any file system that Spark knows will do. Each record
is a gzip member of its own, as usual for archives; the sink's line separator is an empty member. Continuation records are
grouped by the identifier of their origin, put in order of their segment numbers, checked against the total length, and the
chunked transfer framing is taken off.

To find repeats only digests and keys move, and a filter of the revisits goes to where the payloads are. Rows that pass it by
mistake are told by their keys; theirs are the only payloads that move.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, drop_paths, filter_bits, in_bloom, map_arrow, shared_dir, written

#: Block bytes of a record before it goes on in a continuation; bytes of a transfer chunk; records of an archive file.
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
FILE_RECORDS = 512
#: Places in which the rows of one digest meet.
SALTS = 16
#: Bytes that the reader inflates at a time.
PIECE_BYTES = 1 << 20

VERSION = "WARC/1.1"
END = b"\r\n\r\n"
#: A gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in the framing of chunked transfer coding."""
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record, closing line breaks included."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + END


def member(data: bytes) -> bytes:
    """data as a gzip member."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def urn(key: str | None, own_id: str) -> str:
    """Identifier of a page's record: any key is kept, also a null one and one with colons."""
    return f"<urn:page:{'n' if key is None else 'k' + quote(key, safe='')}:{own_id}>"


def key_of(identifier: str) -> str | None:
    """The page's key, of an identifier that urn() has made; others are returned as they are."""
    parts = identifier.strip("<>").split(":")
    if parts[:2] != ["urn", "page"] or len(parts) < 4:
        return identifier.strip("<>")
    return unquote(parts[2][1:]) if parts[2].startswith("k") else None


def head_fields(key: str | None, own_id: str, url: str, digest: str, date: str) -> list[tuple[str, str]]:
    # a line break in an address would end the header field
    return [("WARC-Record-ID", urn(key, own_id)), ("WARC-Date", date), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]


def revisit_record(key: str | None, own_id: str, url: str, digest: str, length: int, refers_to: str, date: str) -> bytes:
    """The record of a page whose payload the response of another page, `refers_to`, holds; its identifier follows from key and digest."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return record([("WARC-Type", "revisit"), *head_fields(key, own_id, url, digest, date), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to, digest)), ("WARC-Refers-To-Date", date)], head)


def response_records(key: str | None, url: str, payload: bytes, date: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """The record of a page, and its continuations. Key and digest identify it, so that revisits can name it."""
    own_id = payload_digest(payload)
    named = head_fields(key, own_id, url, own_id, date)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), *named], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), *named, ("WARC-Segment-Number", "1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:part:{urn(key, own_id)[10:-1]}:{number}>"), ("WARC-Date", date), named[2], ("WARC-Segment-Origin-ID", urn(key, own_id)), ("WARC-Segment-Number", str(number)), *last], part))
    return out


def inflated(data: bytes, piece: int = PIECE_BYTES) -> Iterator[bytes]:
    """The content of an archive file in pieces: all gzip members one after the other, or the bytes themselves if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + piece] for i in range(0, len(data), piece))
        return
    # Members are often a few hundred bytes: what is read ahead of a member's end, and read again, starts small.
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        inflate, ahead = zlib.decompressobj(31), 1 << 12
        while not inflate.eof:
            source = inflate.unconsumed_tail or view[at : at + ahead]
            if not inflate.unconsumed_tail:
                at, ahead = at + len(source), min(2 * ahead, piece)
            part = inflate.decompress(source, piece)
            if part:
                yield part
            elif not len(source) and not inflate.eof:
                raise ValueError("a gzip member is cut short")
        at -= len(inflate.unused_data)
    if bytes(view[at:]).strip(b"\x00"):
        raise ValueError("bytes that are no gzip member follow")


def parse(data: bytes, piece: int = PIECE_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive file; it holds one record and a piece at a time."""
    pieces = inflated(data, piece)
    held = bytearray()

    def more() -> bool:
        part = next(pieces, None)
        held.extend(part or b"")
        return part is not None

    while True:
        while True:
            while held[:2] == b"\r\n":
                del held[:2]
            if len(held) >= 2 or not more():
                break
        if not held:
            return
        if not bytes(held[:5]) == b"WARC/" and len(held) >= 5:
            raise ValueError("no record begins here")
        searched = 0
        while (end := held.find(END, max(searched - 3, 0))) < 0:
            searched = len(held)
            if not more():
                raise ValueError("a record is cut short")
        version, *lines = held[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, size = end + len(END), int(fields["content-length"])
        while len(held) < start + size:
            if not more():
                raise ValueError("a record is cut short")
        block = bytes(held[start : start + size])
        del held[: start + size]
        yield fields, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head_end = block.index(END)
    _, *lines = block[:head_end].decode("latin-1").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, block[head_end + len(END) :]


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record's segments (number, total length, bytes), which must be whole: numbers from 1 on, the total as stated."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    totals = {p[1] for p in parts if p[1] is not None}
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or totals != {len(block)}:
        raise ValueError("segments are missing, repeated or of another total length")
    return block


def _result(fields: dict[str, str], block: bytes) -> tuple:
    """(page, payload_bytes, payload_digest, record_type, refers_to, verified, payload)"""
    headers, body = http_parts(block)
    stated = fields.get("warc-payload-digest")
    stated = stated.removeprefix("sha1:") if stated else None
    if fields["warc-type"] == "revisit":
        refers_to = fields.get("warc-refers-to")
        length = headers.get("content-length")
        return key_of(fields["warc-record-id"]), int(length) if length else None, stated, "revisit", key_of(refers_to) if refers_to else None, None, None
    payload = dechunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body
    found = payload_digest(payload)
    return key_of(fields["warc-record-id"]), len(payload), found, "response", None, found == stated if stated else None, payload


RESULT = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, verified boolean, payload binary"


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    if not payloads:
        columns[6] = [None] * len(rows)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "payload"])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write a record for each row. Of records with equal payloads of at least least_bytes that with the smallest key is a response, others revisit it.

    Null html counts as an empty payload. Rows that share the smallest key are all responses; a null key is a response if
    no other row has its payload, else it revisits. Keys may hold any characters. Other columns don't matter. An empty table
    gives no records. Payloads are written whole, in segments if they are long. Files are named *.warc.gz; identifiers of records are
    unique but for rows that repeat both key and payload."""
    spark, made, date = pages.sparkSession, [], datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    info = rows.select("k", "url", "sha", F.octet_length("payload").cast("long").alias("size"))
    # equal payloads: a task sends on one row for each, however many it meets
    counted = info.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    firsts = counted.where("n > 1 AND first IS NOT NULL").select("sha", "first")
    # one digest may be that of a third of all pages: its rows meet their first one in SALTS places
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = info.withColumn("salt", F.pmod(F.xxhash64("k", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"]).drop("salt")
    again = written(met.where(~F.col("k").eqNullSafe(F.col("first"))), "warc-revisits", made)
    own_hash = F.xxhash64("sha", "k")
    bits = filter_bits(again.count())
    revisited = spark.sparkContext.broadcast(bloom(again.select(own_hash.alias("h")), bits))

    def passing(*filters, negated: bool = False):
        def run(batch: pa.RecordBatch):
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(np.logical_and.reduce([in_bloom(f.value, at) for f in filters]) != negated))

        return run

    # rows that only look like revisits are found by their keys, and then fetched with their payloads
    keys = info.select("sha", "k", own_hash.alias("h"))
    same = lambda one, other: (one["sha"] == other["sha"]) & one["k"].eqNullSafe(other["k"])
    alike = map_arrow(keys, passing(revisited), keys.schema)
    mistaken = written(alike.join(again, same(alike, again), "left_anti"), "warc-mistaken", made)
    mistakes = spark.sparkContext.broadcast(bloom(mistaken.select("h"), bits))
    hashed = rows.withColumn("h", own_hash)
    sure = map_arrow(hashed, passing(revisited, negated=True), hashed.schema)
    maybe = map_arrow(hashed, passing(revisited, mistakes), hashed.schema)
    fetched = maybe.join(mistaken, same(maybe, mistaken), "left_semi")

    def responses(batch: pa.RecordBatch):
        for k, at, body in zip(*batch.columns, strict=True):
            out = [member(r) for r in response_records(k.as_py(), at.as_py(), body.as_py(), date, segment_bytes, chunk_bytes)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    def revisits(batch: pa.RecordBatch):
        out = []
        for k, own, at, sha, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append(member(revisit_record(k, own, at, base64.b32encode(bytes.fromhex(sha)).decode(), size, first, date)))
        yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    text = F.col("k").cast("string").alias("k")
    lines = map_arrow(sure.unionByName(fetched).select(text, "url", "payload"), responses, "value binary")
    lines = lines.unionByName(map_arrow(again.select(text, F.expr("uuid()").alias("own"), "url", "sha", "size", F.col("first").cast("string").alias("first")), revisits, "value binary"))
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_records).text(path)
    _rename(spark, path, ".txt", ".warc.gz")
    drop_paths(spark, made)


def _rename(spark: SparkSession, path: str, ending: str, to: str) -> None:
    """Give the files of a folder another ending, through the Hadoop file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(ending):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(ending) + to))


def read_archives(spark: SparkSession, path: str, payloads: bool = False, made: list[str] | None = None) -> DataFrame:
    """A row for each response and revisit: page, payload_bytes, payload_digest, record_type, refers_to, verified (the digest fits; null for revisits and where none is stated) and, if asked for, payload.

    Reads gzip files of any number of members and plain ones, each in one pass; records of other types are passed over. A page is the
    key that write_archives() got, or else the record's identifier. A file is held compressed and inflated record by record. Raises
    where a record, a gzip member or a chunk is cut short or segments are missing. What is read is written to a table whose path goes
    to `made`, as whole records and segments part ways behind it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("content")
    nothing = pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())
    part_names = ["origin", "number", "total", "digest", "part"]

    def both(results: pa.RecordBatch, part: list | None = None) -> pa.RecordBatch:
        """Rows of results, or one segment without a result."""
        if part:
            columns = [pa.nulls(1, f.type) for f in results.schema] + [pa.array([x], c.type) for x, c in zip(part, nothing)]
        else:
            columns = results.columns + [pa.nulls(results.num_rows, c.type) for c in nothing]
        return pa.record_batch(columns, names=[*results.schema.names, *part_names])

    def records(batch: pa.RecordBatch):
        for content in batch.column(0):
            rows, size = [], 0
            for f, b in parse(content.as_py()):
                if "warc-segment-number" in f and f["warc-type"] in ("response", "continuation"):
                    total = f.get("warc-segment-total-length")
                    yield both(_batch([], payloads), [f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(total) if total else None, f.get("warc-payload-digest"), b])
                elif f["warc-type"] in ("response", "revisit"):
                    rows.append(_result(f, b))
                    size += len(b) if payloads else 500
                    if size > 4 << 20:
                        yield both(_batch(rows, payloads))
                        rows, size = [], 0
            if rows:
                yield both(_batch(rows, payloads))

    def assemble(batch: pa.RecordBatch):
        for origin, digest, parts in zip(*batch.columns, strict=True):
            found = [(p["number"], p["total"], p["part"]) for p in parts.as_py()]
            copies = sum(p[0] == 1 for p in found)
            if copies > 1 and len(set(found)) * copies == len(found):  # repeated rows: the same records, so many times
                found = list(set(found))
            fields = {"warc-record-id": origin.as_py(), "warc-type": "response", "warc-payload-digest": digest.as_py()}
            yield _batch([_result(fields, reassembled(found))] * max(copies, 1), payloads)

    found = written(map_arrow(files, records, f"{RESULT}, origin string, number long, total long, digest string, part binary"), "warc-records", made)
    # a group holds the segments of one page
    grouped = found.where("origin IS NOT NULL").groupBy("origin").agg(F.max("digest").alias("digest"), F.collect_list(F.struct("number", "total", "part")).alias("parts"))
    return found.where("origin IS NULL").drop(*part_names).unionByName(map_arrow(grouped, assemble, RESULT))


def round_trip(pages: DataFrame, key: str = "page_id", least_bytes: int = 0, payloads: bool = False, **options) -> DataFrame:
    """Pages written as archives in the shared folder and read back: key, payload_bytes, payload_digest, record_type, refers_to, verified.

    Without payloads the result is written and the archives are deleted."""
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    path, made = shared_dir(spark, "warc"), []
    write_archives(pages, path, key=key, least_bytes=least_bytes, **options)
    back = read_archives(spark, path, payloads, made)
    back = back.select(F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "verified", *["payload"] * payloads)
    if payloads:
        return back
    back = written(back, "warc-result")
    drop_paths(spark, [path, *made])
    return back
