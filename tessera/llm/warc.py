"""WARC archives: a writer on Spark's text sink and a salvage reader.

``write`` makes one record per row. A record is a row of text whose line separator is the blank lines that end a WARC
record, so Spark's own sink and commit protocol write valid archives to any store. Of rows with equal payloads, the one
with the largest id is a ``response`` record; the others are ``revisit`` records that refer to it and hold the HTTP head
only.

``read`` takes archives of plain records, of one gzip member per record, or both. A record that fails a check (a header,
its length, its end or its payload digest; a member that doesn't decompress) is quarantined: the reader looks for the next
version line or gzip member that begins a valid record, logs the bytes between as a gap with the reason, and goes on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import written

#: Records in an archive file at most; a file is read by one task.
RECORDS = 2048
#: Slots of the bit table that tells payloads that certainly are single. More shared payloads only make it let more through.
BITS = 1 << 22
#: Bytes of a gzip member that are decompressed at once.
PIECE = 1 << 14
END = b"\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def base32_sha1(value: Column) -> Column:
    """SHA-1 in upper-case base32 (40 hex digits are eight groups of 20 bits, four letters each)."""
    hex_ = F.sha1(value)

    def letters(i: Column) -> Column:
        n = F.conv(F.substring(hex_, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_ALPHABET), F.shiftright(n, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)))

    return F.concat(*(letters(F.lit(i)) for i in range(8)))


def write(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", records: int = RECORDS) -> None:
    """Writes ``pages`` to archives under ``path``. A null payload is an empty one, a null url gives no target header, a null id an empty record id.

    Rows repeated with the largest id of their payload are all responses. Ids are compared as they are ordered by Spark;
    null is less than any.
    """
    rows = pages.select(F.col(id).alias("id"), F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "%20").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    # equal payloads are counted before the shuffle; what is shared is a small table
    many = written(rows.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first", F.lit(True).alias("shared")), "shared-payloads")
    # payloads that certainly are single stay where they are; only the others (a few single ones too) are joined, by a
    # shuffle whose skewed keys adaptive execution splits
    place = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    bits = np.zeros(BITS, bool)
    bits[many.select(place.cast("int").alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = True
    byte = F.conv(F.hex(F.substring(F.lit(np.packbits(bits).tobytes()), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.expr("shiftright(__byte, 7 - cast(__place % 8 as int))").bitwiseAND(1) == 1
    rows = rows.withColumns({"__place": place, "__byte": byte})
    columns = ["id", "url", "payload", "digest", "first", "shared"]
    single = rows.where(~maybe).withColumns({"first": F.col("id"), "shared": F.lit(None).cast("boolean")}).select(columns)
    rows = rows.where(maybe).join(many, "digest", "left").select(columns).unionByName(single)
    response = F.col("shared").isNull() | F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), urn("id"), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))).otherwise(""),
        F.when(response, "").otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("first"), F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


def _record(data: bytes, at: int, need_end: bool) -> tuple[dict, int] | str:
    """The record that begins at ``at`` and where the next may begin; or why there is none."""
    line = _VERSION.match(data, at)
    if not line:
        return "no version line"
    head_end = data.find(END, at)
    if head_end < 0:
        return "the header has no end"
    head = {}
    for x in data[line.end() : head_end].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon:
            return "a header line has no colon"
        name = name.strip().lower().decode("latin-1")
        if name in head and name != "warc-concurrent-to":
            return "a header field repeats"  # a header that was cut off and runs into the next one
        head[name] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or "warc-type" not in head:
        return "a needed header is missing"
    begin, end = head_end + 4, head_end + 4 + int(size)
    if end > len(data):
        return "the block is cut off"
    if data[end : end + 4] != END and need_end:
        return "the block's end is not where its length says"
    block = data[begin:end]
    payload, said = block, None
    if "application/http" in head.get("content-type", ""):
        http, split, payload = block.partition(END)
        if not split:
            return "the HTTP head has no end"
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        said = int(found[1]) if found else None
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    declared = head.get("warc-payload-digest", "")
    if head["warc-type"] != "revisit":
        if declared.startswith("sha1:") and declared[5:] != digest:
            return "the payload's digest differs"
        if said is not None and said != len(payload):
            return "the payload's length differs"
    else:
        digest = declared.removeprefix("sha1:") or None
    row = {"record_type": head["warc-type"], "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "target": head.get("warc-target-uri"), "payload_bytes": len(payload) if head["warc-type"] != "revisit" else said, "payload_digest": digest}
    return row, end + 4 if data[end : end + 4] == END else end


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member at ``at``, decompressed, and where it ends; or why not."""
    d, out = zlib.decompressobj(31), []
    try:
        while at < len(data) and not d.eof:  # in pieces: what is left over after the end is copied
            piece = data[at : at + PIECE]
            out.append(d.decompress(piece))
            at += len(piece)
    except zlib.error as e:
        return f"a member does not decompress: {e}"
    return (b"".join(out), at - len(d.unused_data)) if d.eof else "a member is cut off"


def records(data: bytes) -> Iterator[dict]:
    """Rows of kind ``record`` or ``gap``, in order, with the bytes (offset, length) that each covers in ``data``."""
    at, bad = 0, None  # bad: (start, reason) of the gap at hand
    line, gz = -1, -1  # the next places where a record may begin, looked for once
    while at < len(data):
        if data.startswith(b"\x1f\x8b\x08", at):
            got = _member(data, at)
            if not isinstance(got, str):
                body, end = got
                inner = _record(body, 0, False)
                found = inner if isinstance(inner, str) else (inner[0], end) if inner[1] >= len(body.rstrip(b"\r\n")) else "more than a record in a member"
            else:
                found = got
        else:
            found = _record(data, at, True)
        if isinstance(found, str):
            bad = bad or (at, found)
            if line <= at:
                found = _VERSION.search(data, at + 1)
                line = found.start() if found else len(data)
            if gz <= at:
                gz = data.find(b"\x1f\x8b\x08", at + 1)
                gz = len(data) if gz < 0 else gz
            at = min(line, gz)
            continue
        if bad:
            yield {"kind": "gap", "offset": bad[0], "length": at - bad[0], "reason": bad[1]}
            bad = None
        yield {"kind": "record", "offset": at, "length": found[1] - at, **found[0]}
        at = found[1]
    if bad:
        yield {"kind": "gap", "offset": bad[0], "length": len(data) - bad[0], "reason": bad[1]}


_FIELDS = ["archive", "kind", "offset", "length", "reason", "record_type", "record_id", "refers_to", "target", "payload_bytes", "payload_digest"]
SCHEMA = "archive string, kind string, offset long, length long, reason string, record_type string, record_id string, refers_to string, target string, payload_bytes long, payload_digest string"
_ARROW = pa.schema([(n, pa.int64() if n in ("offset", "length", "payload_bytes") else pa.string()) for n in _FIELDS])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives under ``path``; an empty archive gives none."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for r in records(content.as_py() or b""):
                    rows.append(r | {"archive": name.as_py()})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def page_id(urn: str, kind: str = "long") -> Column:
    """The id in a ``<urn:page:...>``."""
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '^<urn:page:(.*)>$', 1), '') as {kind})")
