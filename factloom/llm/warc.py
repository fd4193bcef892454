"""Web archive records: writer and salvage reader.

Records are written as WARC 1.1 text by Spark's text writer, whose line separator is the record
terminator, so the files are plain archives.  The reader takes whole files with ``binaryFile``; it also reads
archives of one gzip member per record.  After a failed check it looks for the next version line or gzip
member, goes on there, and logs the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, saved, small_or_plain

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Payload bytes of a record at most, and records in one archive file of such: a file stays near 64 MB unless a single record is longer.
FILE_RECORDS = ((64 << 10, 1000), (1 << 20, 64), (16 << 20, 4), (None, 1))
#: Payloads of at least so many bytes may be replaced by a revisit record.
REVISIT_BYTES = 1000

_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def classify(pages: DataFrame, page_id: str, payload: str) -> DataFrame:
    """Adds payload_bytes, payload_digest, refers_to (null for a response)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumns(
        {"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body.cast("binary"))}
    )
    chosen = saved(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"))
        .agg(F.max(page_id).alias("_to"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("_d", "_b", "_to"),
        "revisits",
    )
    hit = (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b"))
    return rows.join(small_or_plain(chosen, 100), hit, "left").withColumn(
        "refers_to", F.when(F.col(page_id).eqNullSafe(F.col("_to")), F.lit(None)).otherwise(F.col("_to"))
    ).drop("_d", "_b", "_to")


def record_text(page_id="page_id", url="url", payload="html"):
    """One record without its terminator, from the columns of :func:`classify`."""
    line = lambda name, v: F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit("")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    uri = F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "%20")
    exact = F.when(uri != F.col(url), F.base64(F.col(url).cast("binary")))  # so that the reader gives back what was written
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", urn(page_id)), line("WARC-Target-URI", uri), line("X-Target-URI-Base64", F.replace(exact, F.lit("\r\n"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", urn("refers_to")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(body.cast("binary")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )


def write_warc(pages: DataFrame, path: str, page_id="page_id", url="url", payload="html") -> None:
    """Write one record per row.  Null payloads are empty; null ids and urls leave their header out.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes the largest id is the response; if several rows have that id,
    each of them is one.  Repeated rows are records of their own; an empty table writes no record; other columns are ignored.
    """
    rows = classify(pages.select(F.col(page_id), F.col(url), F.col(payload)), page_id, payload)
    text = rows.select("payload_bytes", record_text(page_id, url, payload).alias("value"))
    size = F.coalesce(F.octet_length(F.col(payload)), F.lit(0))
    kind = F.lit(len(FILE_RECORDS) - 1)
    for k in range(len(FILE_RECORDS) - 2, -1, -1):
        kind = F.when(size <= FILE_RECORDS[k][0], k).otherwise(kind)
    here = sorted(r.k for r in pages.select(kind.alias("k")).distinct().collect()) or [0]
    low = [-1, *[x for x, _ in FILE_RECORDS[:-1]]]
    for k in here:
        most, records = FILE_RECORDS[k]
        own = (F.col("payload_bytes") > low[k]) & (F.lit(True) if most is None else F.col("payload_bytes") <= most)
        text.where(own).select("value").write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the offset behind it; ValueError says which check failed."""
    if data[at : at + 7] != b"WARC/1." or data[at + 8 : at + 10] != b"\r\n":
        raise ValueError("no version line")
    head = data.find(END, at)
    if head < 0:
        raise ValueError("header without end")
    fields = {}
    for row in data[at:head].split(b"\r\n")[1:]:
        key, colon, value = row.partition(b":")
        if not colon:
            raise ValueError("broken header line")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = head + 4
    stop = start + int(fields["content-length"])
    if stop + 4 > len(data) or data[stop : stop + 4] != END:
        raise ValueError("wrong content length")
    body = data[start:stop]
    if (block := fields.get("warc-block-digest")) and block != "sha1:" + hashlib.sha1(body).hexdigest():
        raise ValueError("block digest differs")
    if fields.get("warc-type") == "response" and (own := fields.get("warc-payload-digest")) and own != "sha1:" + hashlib.sha1(body).hexdigest():
        raise ValueError("payload digest differs")
    return {"fields": fields, "body": body}, stop + 4


def salvage(data: bytes):
    """Yield ("record", start, stop, record) and ("gap", start, stop, reason) over a whole archive."""
    at, bad, why, n = 0, -1, "", len(data)
    while at < n:
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                z, parts, stop = zlib.decompressobj(31), [], at
                try:
                    while not z.eof and stop < n:
                        parts.append(z.decompress(data[stop : stop + 65536]))
                        stop = min(stop + 65536, n)
                except zlib.error as e:
                    raise ValueError(f"member: {e}") from None
                if not z.eof:
                    raise ValueError("member is cut off")
                plain = b"".join(parts)
                record, used = _record(plain, 0)
                if used != len(plain):
                    raise ValueError("member holds more than a record")
                stop -= len(z.unused_data)
            else:
                record, stop = _record(data, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else n
            continue
        if bad >= 0:
            yield "gap", bad, at, why
            bad = -1
        yield "record", at, stop, record
        at = stop
    if bad >= 0:
        yield "gap", bad, n, why


READ = (
    "path string, start long, stop long, gap string, record_type string, record_id string, url string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, held = [], 0
            for kind, start, stop, x in salvage(content.as_py()):
                if kind == "gap":
                    rows.append((path, start, stop, x, *[None] * 7))
                    continue
                f, body = x["fields"], x["body"]
                digest, size = hashlib.sha1(body).hexdigest(), len(body)
                if f.get("warc-type") == "revisit":  # its payload is another record's, so its headers are all there is
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size = int(f["x-payload-length"]) if f.get("x-payload-length", "").isdigit() else None
                url = f.get("warc-target-uri")
                if exact := f.get("x-target-uri-base64"):
                    url = base64.b64decode(exact).decode("utf-8", "replace")
                rows.append((path, start, stop, None, f.get("warc-type"), f.get("warc-record-id"), url, f.get("warc-refers-to"), digest, size, body))
                held += len(body)
                if held > 8 << 20:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)


def _table(rows):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_warc(spark, path: str) -> DataFrame:
    """Records and gaps of every file under ``path``; a row with ``gap`` set is a quarantined byte range.

    Size and digest of a response are worked out from the payload that was read, those of a revisit are its headers'.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, READ)
