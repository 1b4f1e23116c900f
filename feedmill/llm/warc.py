"""WARC archives: records written by Spark's text sink, read back by a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm.common import new_path, written

#: Bytes of one archive file at most, but for a single larger record: a reader's task holds one file at a time.
FILE_BYTES = 64 << 20
#: Payload bytes that bound the classes of pages which go to files of their own, so that as many records as fit are known.
CLASSES = (1 << 14, 1 << 17, 1 << 20, 1 << 23)
#: Bytes that a record may have beside payload and target.
HEAD_BYTES = 1 << 10
#: Digests of repeated payloads up to which their table may be broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000
PREFIX = "urn:feedmill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: twenty bits, that is four signs, at a time."""
    signs = []
    for group in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*signs)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record: the WARC record of every page as text, without the two line ends that close it.

    Of pages with equal payloads (equal SHA-1) of least_bytes or more, that with the largest page_id is a
    response and the others revisit it. Null html is an empty payload, a null url leaves out the target.
    A null page_id counts as smaller than any other; repeated rows of the largest id are all responses.
    Only digests and ids are shuffled; payloads are, too, if more than BROADCAST_ROWS payloads repeat.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("hash", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    repeated = written(page.where(F.col("bytes") >= least_bytes).groupBy("hash").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("hash", "top"), "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    page = page.join(F.broadcast(repeated) if few else repeated, "hash", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit(f"<{PREFIX}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("hash")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("top"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", digest),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    return page.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive files of whole records under path, in any store that Spark writes to, each of FILE_BYTES at most.

    Records are dealt by size into classes, and a file takes as many as fit if all were of the class's bound;
    beyond the last class each record has a file of its own. Only classes that occur are written.
    """
    made = records(pages, least_bytes).withColumn("bytes", F.octet_length("record"))
    bounds = [bound + HEAD_BYTES for bound in CLASSES]
    kind = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        kind = F.when(F.col("bytes") <= bounds[k], k).otherwise(kind)
    sizes = pages.select((F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0)) + 2 * HEAD_BYTES).alias("most"))
    largest = sizes.agg(F.max("most")).first()[0] or 0
    for k in range(len(bounds) + 1):
        if k and largest <= bounds[k - 1]:
            break
        most = max(1, FILE_BYTES // (bounds[k] + 4)) if k < len(bounds) else 1
        made.where(kind == k).select("record").write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the valid record at a place; ValueError says what is wrong with it."""
    if not (found := _VERSION.match(data, at)):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", found.end() - 2)
    if end < 0:
        raise ValueError("headers without end")
    head = _headers(data[found.end() : end].decode("utf-8", "replace"))
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = end + 4
    stop = start + int(head["content-length"])
    if stop + 4 > len(data):
        raise ValueError("record is cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record has another length")
    block = data[start:stop]
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload(head, block)).digest()).decode() != digest[5:]:
        raise ValueError("payload has another digest")
    return head, block, stop + 4


def _headers(raw: str) -> dict[str, str]:
    """Fields by lower-case name: folded lines belong to the field before, values of a repeated field stand in lines, but a length or type must not repeat."""
    head: dict[str, str] = {}
    name = ""
    for line in raw.split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            head[name] = f"{head[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError("header without name")
        if name in head and name in ("content-length", "warc-type", "warc-record-id"):
            raise ValueError("header stands twice")
        head[name] = f"{head[name]}\n{value.strip()}" if name in head else value.strip()
    return head


def payload(head: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP headers."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _plain(data: bytes, base: int = 0) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        try:
            head, block, end = _record(data, at)
            yield "record", base + at, end - at, head, block
            at = end
        except ValueError as wrong:
            where = at + 1
            while True:  # the next place at which a whole record is valid
                found = _VERSION.search(data, where)
                where = found.start() if found else len(data)
                if not found:
                    break
                try:
                    _record(data, where)
                    break
                except ValueError:
                    where += 1
            yield "gap", base + at, where - at, str(wrong), None
            at = where


def _inflated(view: memoryview, at: int) -> tuple[bytes, int]:
    """Content and length of the gzip member at a place, which is fed in growing parts so that what follows is not copied."""
    engine, parts, part, end = zlib.decompressobj(31), [], 1 << 14, at
    while not engine.eof and end < len(view):
        parts.append(engine.decompress(view[end : end + part]))
        end = min(len(view), end + part)
        part = min(2 * part, 1 << 20)
    if not engine.eof:
        raise ValueError("gzip member is cut short")
    return b"".join(parts), end - len(engine.unused_data) - at


def _members(data: bytes) -> Iterator[tuple]:
    """Gzip members one after the other; offsets are those of the members."""
    at, lost, why, view = 0, None, "", memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] != _MEMBER:
                raise ValueError("no gzip member")
            raw, size = _inflated(view, at)
            if not _VERSION.match(raw):
                raise ValueError("gzip member without a version line")
        except (ValueError, zlib.error) as wrong:
            if lost is None:
                lost, why = at, str(wrong)
            found = data.find(_MEMBER, at + 1)
            at = found if found >= 0 else len(data)
            continue
        if lost is not None:
            yield "gap", lost, at - lost, why, None
            lost = None
        for kind, _, _, a, b in _plain(raw):
            yield kind, at, size, a, b
        at += size
    if lost is not None:
        yield "gap", lost, len(data) - lost, why, None


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) of every valid record and ("gap", offset, length, reason, None) of every quarantined range.

    After a failed check the search goes on at the next version line, or in a compressed file at the next
    gzip member, that begins a valid record; whatever lies between is one gap.
    """
    yield from _members(data) if data[:2] == _MEMBER[:2] or (data[:5] != b"WARC/" and _MEMBER in data and not _VERSION.search(data)) else _plain(data)


SCHEMA = "file string, kind string, offset long, length long, reason string, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for every record and every gap of the archive files under path (SCHEMA).

    A file is read whole by one task, as gzip members or plain records; digest and size of a revisit's payload
    are those that its record states. Empty files give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]

        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, name = [], 0, file.as_py()
                for kind, offset, length, a, b in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((name, kind, offset, length, a, *[None] * 7))
                        continue
                    body = payload(a, b)
                    whole = a.get("warc-type") != "revisit"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else a.get("warc-payload-digest", "").removeprefix("sha1:")
                    stated = a.get("x-payload-length", "")
                    count = len(body) if whole else int(stated) if stated.isdigit() else None
                    rows.append((name, kind, offset, length, None, a.get("warc-type"), a.get("warc-record-id"), a.get("warc-target-uri"), a.get("warc-refers-to"), digest, count, body if with_payload else None))
                    size += len(body) * with_payload
                    if size > 16_000_000 or len(rows) >= 10_000:
                        yield flushed(rows)
                        rows, size = [], 0
                if rows:
                    yield flushed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{PREFIX}([-0-9]+)>', 1) as long)")
    return read_archives(spark, path, with_payload=False).where("kind = 'record'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
