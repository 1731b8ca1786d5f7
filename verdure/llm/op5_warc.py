"""Operator 5, WARC: a writer, and a reader that salvages what it can.

Writing: each record is a gzip member of its own (or plain text).  Spark's text writer writes the members, so archives go from executors
to any store that Spark writes to; its line separator is the last byte of the member, a zero.  Of equal payloads of
at least `least` bytes the one with the largest key is the response, the others are revisits of it.
Reading: a file may hold gzip members and plain records in any order.  A gzip member that can't be read and a record that fails a check (version
line, headers, length, end, block digest) are skipped up to the next member or version line that can be read, whichever comes first, and the skipped
bytes are logged as a row of kind "gap", without what was recovered of a damaged member's content.  Offsets of records in a gzip member count from the start of its content; plain records have member 0 and offsets in the file.
A file is held by one task; write_archives() begins a new file when one has FILE_BYTES, so only a single larger record makes a larger file.  Payloads stay where they
were read: digests are aggregated, and those of several pages, up to BROADCAST of them, go out to all tasks; more are joined by a shuffle, with the same result.

Edge cases: null html is an empty payload; a null URL has no target header, line ends and % in a URL are percent-coded;
a null key is written as such and read back as null; rows that repeat the largest key are responses each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LEAST, FILE_BYTES, BROADCAST = 1000, 64 << 20, 500_000
END = "\r\n\r\n"
FIELDS = "file string, kind string, member long, offset long, length long, reason string, warc_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """A column `record` with the text of each page's record, without the end."""
    pages = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("rank"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    first = c.checkpointed(pages.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    pages = pages.join(F.broadcast(first) if first.count() <= BROADCAST else first, "digest", "left")
    revisit = (F.col("first") != F.col("rank")) | (F.col("first").isNotNull() & F.col("rank").isNull())
    pages = pages.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    pages = pages.withColumn("block", block)
    target = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), target), F.lit("")),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Block-Digest: sha1:"), F.sha1(F.encode("block", "UTF-8")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    ).alias("record"))


def _in_files(gzipped: bool):
    """Records as gzip members without their last byte, which is zero: that of the size, or of an empty member after one of 16 MB or more; or as they are. With the file each belongs to."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, file, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out, files, held = [], [], 0
            for record in batch.column(0):
                data = record.as_py().encode()
                if gzipped:
                    made = gzip.compress(data + END.encode(), 6, mtime=0)
                    data = (made if made[-1] == 0 else made + gzip.compress(b"", mtime=0))[:-1]
                if size and size + len(data) > FILE_BYTES:
                    file, size = file + 1, 0
                size, held = size + len(data) + len(END), held + len(data)
                out.append(data)
                files.append(f"{task:08d}-{file:06d}")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files)], names=["record", "archive"])
                    out, files, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files)], names=["record", "archive"])

    return add


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **names) -> None:
    """compression: gzip, a member a record; else that of Spark's text writer over the whole file. Files lie in a folder each, archive=task-number."""
    gzipped = compression == "gzip"
    out = c.map_arrow(records(pages, **names), _in_files(gzipped), "record binary, archive string").select(F.col("record").cast("string"), "archive")
    out.write.partitionBy("archive").option("lineSep", "\0" if gzipped else END).option("compression", "none" if gzipped else compression).text(path)


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"


def inflated(data: bytes, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """(content, end, reason, marks) of the gzip member from `at` on; with a reason: what could be inflated, how far that went, and places in the file with the content's size there."""
    inflate, out, step, end = zlib.decompressobj(31), [], 1024, at
    try:
        while not inflate.eof and end < len(data):
            out.append(inflate.decompress(data[end : end + step]))
            end, step = min(end + step, len(data)), min(2 * step, 1 << 18)
    except zlib.error:
        pass
    else:
        if inflate.eof:
            return b"".join(out), end - len(inflate.unused_data), "", []
    inflate, good, end, size, marks, reason = zlib.decompressobj(31), [], at, 0, [(at, 0)], "member is cut off"  # again in small steps
    try:
        while end < len(data):
            good.append(inflate.decompress(data[end : end + 64]))
            end, size = min(end + 64, len(data)), size + len(good[-1])
            marks.append((end, size))
    except zlib.error:
        reason = "member is damaged"
    return b"".join(good), end, reason, marks


def next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins whose content begins as a record does; else the end."""
    at = data.find(MEMBER, at)
    while at >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 64).startswith(b"WARC/"):
                return at
        except zlib.error:
            pass
        at = data.find(MEMBER, at + 1)
    return len(data)


def next_line(data: bytes, at: int) -> int:
    found = VERSION.search(data, at)
    return found.start() if found else len(data)


def _parts(data: bytes) -> Iterator[tuple[int, int, int, dict[str, str] | None, bytes, str]]:
    """(member, start, end, headers or None for a gap, block, reason) over all bytes of a file."""
    at, bad, why, member, line = 0, -1, "", -1, -1
    while at < len(data):
        reason, resume, gz = "no version line", at + 1, data.startswith(MEMBER, at)
        if gz:
            content, end, reason, marks = inflated(data, at)
            resume = max(end, at + 1)
        elif VERSION.match(data, at):
            end, headers, block, reason = record(data, at)
        if bad >= 0 and (gz or not reason):
            yield 0, bad, at, None, b"", why
            bad = -1
        if not reason:
            if gz:
                yield from ((at, *x) for x in parse(content))
            else:
                yield 0, at, end, headers, block, ""
            at = end
            continue
        if member <= at:
            member = next_member(data, at + 1)
        if line < resume:  # not in what was inflated: it is looked through as the member's content
            line = next_line(data, resume)
        after = min(member, line)
        if gz:
            found = [x for x in parse(content) if x[2] is not None]
            yield from ((at, *x) for x in found)
            # The bytes behind the last record that came back, as near as the marks tell, are lost; so are those before the first.
            well = found[-1][1] if found and found[0][0] == 0 else 0
            since = max(place for place, size in marks if size <= well) if well else at
            yield 0, since, after, None, b"", reason
        elif bad < 0:
            bad, why = at, reason
        at = after
    if bad >= 0:
        yield 0, bad, len(data), None, b"", why


def record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes, str]:
    """(end, headers, block, reason) of the record whose version line is at `at`."""
    headers, block, end = {}, b"", 0
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return end, headers, block, "headers are cut off"
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head].decode("utf-8", "replace").split("\r\n")[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit():
        return end, headers, block, "no length"
    block = data[head + 4 : head + 4 + int(size)]
    end = head + 8 + int(size)
    told = headers.get("warc-block-digest", "")
    why = "record is cut off" if len(block) < int(size) else "no end of record" if data[end - 4 : end] != b"\r\n\r\n" else "block digest differs" if told.startswith("sha1:") and hashlib.sha1(block).hexdigest() != told[5:].lower() else ""
    return end, headers, block, why


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(start, end, headers or None for a gap, block, reason) over all bytes of a member's content."""
    at, bad, reason = 0, -1, ""
    while at < len(data):
        why = "no version line"
        if VERSION.match(data, at):
            end, headers, block, why = record(data, at)
        if not why:
            if bad >= 0:
                yield bad, at, None, b"", reason
                bad = -1
            yield at, end, headers, block, ""
            at = end
            continue
        if bad < 0:
            bad, reason = at, why
        after = VERSION.search(data, at + 1)
        at = after.start() if after else len(data)
    if bad >= 0:
        yield bad, len(data), None, b"", reason


def _rows(file: str, data: bytes, payload: bool) -> Iterator[tuple]:
    for start, a, b, headers, block, why in _parts(data):
        if headers is None:
            yield file, "gap", start, a, b - a, why, *[None] * 7
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        kind = headers.get("warc-type")
        if not head.startswith(b"HTTP/"):
            head, body = b"", block
        if kind == "revisit":
            told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
            size, digest = int(told[1]) if told else None, headers.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
        else:
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        yield file, "record", start, a, b - a, None, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, body if payload else None


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """FIELDS: a row for each record, and for each gap."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FIELDS.split(", "))])
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for row in _rows(file, data.as_py() or b"", payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return c.map_arrow(files.select("path", "content"), read, FIELDS)


def op5_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    folder = f"{c.checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(c.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    page = lambda x: F.nullif(F.regexp_extract(x, r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    read = read_archives(spark, folder, payload=False).filter("kind = 'record'")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
