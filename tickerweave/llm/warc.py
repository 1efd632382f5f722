"""WARC archives: a writer that replaces repeated payloads by revisits, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerweave.llm.common import cut, lookup, shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"

RECORD = ("file string, offset long, length long, kind string, record_id string, target_uri string, refers_to string, "
          "payload_bytes long, payload_digest string, payload binary, gap_reason string")
_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("gap_reason", pa.string()),
])


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's bytes: eight times 20 bits, four letters each."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for k in range(32):
        bits = F.conv(F.substring(digest, 1 + 5 * (k // 4), 5), 16, 10).cast("int")
        letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * (k % 4)).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_bytes: int = 0, records_per_file: int = 2000) -> str:
    """Writes one WARC 1.1 record per row into a new shared folder, and returns the folder.

    Of equal payloads of at least min_bytes bytes the one with the largest id is a response and the
    others are revisits that refer to it. A file holds at most records_per_file records. Digests meet
    as (digest, id) pairs without their payloads; a payload that a large share of rows hold is counted
    with partial maxima and looked up by broadcast. Records are written by Spark's text writer, whose
    separator closes each record, so any file system that Spark knows will do.

    NULL payload: no bytes. NULL url: no target header. NULL id: a response of its own, without an id.
    Repeated rows that hold the largest id are all responses. An empty table gives an empty folder.
    Other columns are not written.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body"))).withColumn("k", F.xxhash64("digest"))
    shared = rows.filter(F.col("id").isNotNull() & (F.octet_length("body") >= min_bytes))
    best = shared.groupBy("k", "digest").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lookup(rows, cut(best), ("k", "digest"), "n", ["best"], F.xxhash64("id"))

    revisit = (F.col("id") < F.col("best")) & (F.octet_length("body") >= min_bytes)
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        header("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page:>"))),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Refers-To", F.when(revisit, urn(F.col("best")))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("X-Payload-Length", F.octet_length("body").cast("string")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.octet_length("body").cast("string")), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("body")),
    )
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    found.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(folder)
    return folder


# --- reading ---------------------------------------------------------------------------------


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """Fields of the record that starts at a version line, and where it ends. ValueError if a check fails."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(_END, at)
    if end < 0:
        raise ValueError("headers without an end")
    head = _headers(data[at:end])
    length = head.get("content-length", "")
    if not length.isdecimal():
        raise ValueError("no valid content length")
    start = end + 4
    stop = start + int(length)
    if stop + 4 > len(data):
        raise ValueError("record is cut off")
    if data[stop : stop + 4] != _END:
        raise ValueError("record does not end where its length says")
    payload = data[start:stop]
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if digest and kind != "revisit" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("payload does not match its digest")
    size = head.get("x-payload-length", "")
    return {
        "kind": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"), "payload_digest": digest or None, "payload": payload,
        "payload_bytes": int(size) if kind == "revisit" and size.isdecimal() else None if kind == "revisit" else len(payload),
    }, stop + 4


def _member(data: bytes, at: int) -> tuple[dict, int]:
    """The record of the gzip member at this place, and where the member ends."""
    inflate = zlib.decompressobj(31)
    parts, next_ = [], at
    try:
        while not inflate.eof and next_ < len(data):
            parts.append(inflate.decompress(data[next_ : next_ + 65536]))
            next_ = min(next_ + 65536, len(data))
    except zlib.error as exc:
        raise ValueError(f"damaged member: {exc}") from None
    if not inflate.eof:
        raise ValueError("member is cut off")
    plain = b"".join(parts)
    fields, end = parse_record(plain, 0)
    if end != len(plain):
        raise ValueError("member holds more than its record")
    return fields, next_ - len(inflate.unused_data)


def salvage(data: bytes):
    """Records of an archive, plain or one gzip member each, and its damaged gaps, as (offset, length, fields).

    After a failed check the reader looks for the next version line or member whose record passes all checks, also
    in mid-line, as a record that was cut off leaves it, and goes on there; the bytes between are one gap with the reason of
    the first failure. Every byte is in a record or a gap.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            fields, end = (_member if data.startswith(_MEMBER, at) else parse_record)(data, at)
        except ValueError as exc:
            if bad is None:
                bad, reason = at, str(exc)
            line = _VERSION.search(data, at + 1)
            member = data.find(_MEMBER, at + 1)
            places = [p for p in (line.start() if line else -1, member) if p >= 0]
            at = min(places) if places else len(data)
            continue
        if bad is not None:
            yield bad, at - bad, {"kind": "gap", "gap_reason": reason}
            bad = None
        yield at, end - at, fields
        at = end
    if bad is not None:
        yield bad, len(data) - bad, {"kind": "gap", "gap_reason": reason}


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record and per quarantined gap (kind "gap": offset, length and gap_reason) of all files in folder.

    Files are read whole, one row each, so they are bounded by what a task can hold; write_archives
    keeps them small. payload is NULL unless asked for. An empty folder gives no rows, an empty file none.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def read(batches):
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for offset, length, fields in salvage(content.as_py()):
                    rows.append({"file": path.as_py(), "offset": offset, "length": length, **fields})
                    if not with_payload:
                        rows[-1]["payload"] = None
                    held += 200 + (length if with_payload else 0)
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(read, RECORD)
