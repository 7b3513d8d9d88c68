"""WARC archives: a writer with revisit records and a salvage reader.

Records are UTF-8 text, so Spark's own text writer stores them, with the blank lines that
end a record as its separator: archives land in any file system that Spark can write.
The reader checks each record's version line, headers, length, end and payload digest.
Where a check fails it looks for the next gzip member or version line that starts a valid
record, goes on from there, and reports the bytes between as a quarantined gap.

A null html is an empty payload, a null url leaves the target out; line breaks in a url are
escaped. Each row gives a record, rows with a null or repeated page_id too: a null one is a
response with an empty id, and of rows with one page_id and one payload none revisits the
other. An empty table gives no archive. Only page_id, url and html are read, whatever other
columns there are. A damaged record that holds a whole valid record in its payload has that
inner record recovered in its place.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_IDS, arrow_schema, arrow_settings, as_batch, give_back, joined_small_hot, scratch_dir, scratch_path, stored, table

END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Records of one archive at most, and payload bytes, unless one record alone has more: archives are read as one value each.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 128 << 20
#: Compressed bytes that are read at a time.
CHUNK = 1 << 16
DATE = "2026-01-01T00:00:00Z"

_START = re.compile(rb"\x1f\x8b\x08|(?<![^\n])WARC/1\.[01]\r\n")
_ITEM = "path string, kind string, start long, size long, reason string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digested(pages: DataFrame) -> DataFrame:
    """page_id, digest and size of the payloads that are long enough to be revisited; stored."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return stored(pages.select("page_id", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).cast("long").alias("size")).filter(F.col("size") >= REVISIT_BYTES), "warc-digests")


def decisions(rows: DataFrame) -> DataFrame:
    """Of digested() rows those that revisit another's payload: page_id, a check of the digest, and the id of the response; stored."""
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = joined_small_hot(rows, stored(groups, "warc-groups"), "digest", "n", rows.count()).filter("page_id <> refers_to")
    return stored(again.select("page_id", F.xxhash64("digest").alias("check"), "refers_to").distinct(), "warc-revisits")


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One WARC record a page, as text without the blank lines at its end.

    At most BROADCAST_IDS revisits, which are counted, are broadcast, so pages don't move; with more, pages are shuffled once.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(body).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    new = F.col("refers_to").isNull()
    block = F.when(new, F.concat(http, body)).otherwise(http)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(new, "response").otherwise("revisit")),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body.cast("binary")))),
        F.when(new, "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", page("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    few = revisits.count() <= BROADCAST_IDS
    keyed = pages.select("page_id", "url", "html", F.xxhash64(F.unhex(F.sha1(body.cast("binary")))).alias("check"))
    joined = keyed.join(F.broadcast(revisits) if few else revisits, ["page_id", "check"], "left")
    return joined.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Archives of all pages under path. Payloads of which ARCHIVE_RECORDS exceed ARCHIVE_BYTES go to archives of fewer records."""
    rows = digested(pages)
    revisits, most = decisions(rows), rows.agg(F.max("size")).first()[0] or 0
    usual = ARCHIVE_BYTES // ARCHIVE_RECORDS
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    parts = [("part", pages, ARCHIVE_RECORDS)] if most <= usual else [("usual", pages.filter(size <= usual), ARCHIVE_RECORDS), ("large", pages.filter(size > usual), max(1, ARCHIVE_BYTES // most))]
    for name, part, n in parts:
        records(part, revisits).write.option("lineSep", END).option("maxRecordsPerFile", n).text(f"{path}/{name}")


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    return gzip.compress(record + END.encode(), mtime=0)


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of headers")
    first, *lines = data[at:end].split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no version line")
    out = {}
    for x in lines:
        name, colon, value = x.decode("utf-8").partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place and where it ends; ValueError says which check failed."""
    head, block = _headers(data, at)
    if not (n := head.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    end = block + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
    http = data.find(b"\r\n\r\n", block, end)
    if http < 0:
        raise ValueError("no HTTP headers")
    size = re.search(rb"(?i)^content-length: *(\d+)", data[block:http], re.M)
    payload = data[http + 4 : end] if kind == "response" else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload's digest differs")
    if kind not in ("response", "revisit") or not size or payload is not None and len(payload) != int(size[1]):
        raise ValueError("the record's type or payload length is wrong")
    own, other = (re.fullmatch(r"<urn:x-page:(-?\d*)>", head.get(x, "")) for x in ("warc-record-id", "warc-refers-to"))
    if not own or (kind == "revisit") != bool(other):
        raise ValueError("a record id is missing")
    number = lambda m: int(m[1]) if m and m[1] else None
    return {"page_id": number(own), "record_type": kind, "refers_to": number(other), "payload_bytes": int(size[1]), "payload_digest": digest, "payload": payload}, end + 4


def _members(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at a place, or the plain record there."""
    if data[at : at + 2] != b"\x1f\x8b":
        record, end = _record(data, at)
        return [record], end
    d, view, parts, end = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not d.eof and end < len(data):
            parts.append(d.decompress(view[end : end + CHUNK]))
            end += CHUNK
    except zlib.error as e:
        raise ValueError(f"the gzip member is damaged: {e}") from None
    if not d.eof:
        raise ValueError("the gzip member is cut short")
    plain, end = b"".join(parts), min(end, len(data)) - len(d.unused_data)
    out, place = [], 0
    while place < len(plain):
        record, place = _record(plain, place)
        out.append(record)
    return out, end


def salvage(data: bytes) -> Iterator[dict]:
    """All records of an archive that pass the checks, and the gaps between them, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = _members(data, at)
        except (ValueError, UnicodeDecodeError) as e:
            if gap is None:
                gap, reason = at, str(e)[:200]
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "start": gap, "size": at - gap, "reason": reason}
            gap = None
        for x in found:
            yield {"kind": "record", "start": at, "size": end - at} | x
        at = end
    if gap is not None:
        yield {"kind": "gap", "start": gap, "size": len(data) - gap, "reason": reason}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under path."""
    schema = arrow_schema(_ITEM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                items = [x | {"path": name} for x in salvage(data.as_py())]
                if not payloads:
                    for x in items:
                        x.pop("payload", None)
                if items:
                    yield as_batch({c: [x.get(c) for x in items] for c in schema.names}, schema)
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, _ITEM)


def read_logged(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The records under path, without their payloads; the gaps go to a JSON log at another path, one line each, which isn't written where there are none."""
    items = stored(read(spark, path, payloads=False).drop("payload"), "warc-items")
    gaps = items.filter("kind = 'gap'").select("path", "start", "size", "reason")
    if not gaps.isEmpty():
        gaps.write.mode("append").json(log)
    return items.filter("kind = 'record'")


def gap_log(spark: SparkSession, name: str = "op5") -> str:
    """Where a query's quarantined gaps are logged: beside the scratch tables, but kept."""
    return f"{scratch_dir(spark)}/warc-gaps-{name}"


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op5: pages written as archives, read back."""
    arrow_settings(spark)
    path = scratch_path(spark, "warc")
    write(spark, table(spark, sf_dir, "pages"), path)
    return read_logged(spark, path, gap_log(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
