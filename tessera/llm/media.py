"""Media columns: whole texts kept losslessly in baseline JPEG files, read back, with dimensions and thumbnail hashes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jpeg
from tessera.llm import words as W

#: Bytes of payload that a task works on at once (one longer text is worked on alone).
AT_ONCE = 3 << 19
#: What a file that is no baseline JPEG may make the decoder raise.
DAMAGED = (jpeg.Unreadable, ArithmeticError, IndexError, KeyError, MemoryError, ValueError)


def padded(raw: bytes) -> bytes:
    """``raw`` with spaces up to a positive multiple of 192 bytes."""
    return raw + b" " * (-len(raw) % jpeg.UNIT if raw else jpeg.UNIT)


def with_media(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, n_bytes and the binary column ``media``: a JPEG whose coefficients are the bytes of the whole text.

    A null or empty text is stored as 192 spaces, n_bytes 0. One row in, one row out: repeated rows, null ids and ties stay.
    Other columns are not read. An empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text", AT_ONCE):
                raw = [(x or "").encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
                media = jpeg.encode([padded(x) for x in raw])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id " + kind + ", n_bytes long, media binary").withColumnRenamed("id", id)


def read_media(table: DataFrame, *, id: str = "doc_id", media: str = "media") -> DataFrame:
    """What each stored JPEG holds: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, thumb_hash, feature, error.

    The payload columns are of the coefficients read back; they are null for a JPEG of another writer. Bytes that are no
    baseline JPEG (or null) give null columns and the reason in ``error``.
    """
    kind = table.schema[id].dataType.simpleString()
    passed = [c for c in table.columns if c not in (id, media) and c in ("n_bytes",)]

    def look(file: bytes, got) -> tuple:
        frame, blocks = got
        image = jpeg.thumbnail(frame, blocks)
        mark = f"{jpeg.difference_hash(image):016x}"
        feature = f"{frame.width}x{frame.height}:{mark}:{hashlib.md5(image.tobytes(), usedforsecurity=False).hexdigest()[:16]}"
        try:
            own = jpeg.payload(frame, blocks)
        except jpeg.Unreadable:
            own = None
        stored = (len(file), hashlib.sha256(file).hexdigest(), frame.width, frame.height, mark, feature, None)
        return (*((None,) * 3 if own is None else (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]))), *stored)

    def one(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * 9 + ("null",)
        try:
            return look(file, jpeg.decode([file])[0])
        except DAMAGED as e:
            return (None, None, None, len(file), hashlib.sha256(file).hexdigest(), None, None, None, None, f"{type(e).__name__}: {e}")

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumb_hash", "feature", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "media", AT_ONCE * 3 // 2):
                files = part.column("media").to_pylist()
                try:
                    rows = [look(f, got) for f, got in zip(files, jpeg.decode(files), strict=True)]
                except (*DAMAGED, TypeError):  # one of them is damaged: each by itself
                    rows = [one(f) for f in files]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in passed), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *passed, *names])

    schema = f"id {kind}, " + "".join(f"{c} long, " for c in passed) + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string, feature string, error string"
    return table.select(F.col(id).alias("id"), *passed, F.col(media).alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id)
