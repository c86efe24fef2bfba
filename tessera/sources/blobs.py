"""Content-addressed blobs: a table of (hash, content), one row for each content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "CAS:"


def addressed(contents: DataFrame, content: str = "content") -> DataFrame:
    """(hash, size, copies, content) of the distinct contents. Hashes are grouped, so equal contents meet as counts before the shuffle."""
    rows = contents.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.octet_length(F.col(content)).cast("long").alias("size"), F.col(content).cast("binary").alias("content"))
    # the size is taken before the group: where the contents are not asked for, they are not shuffled
    return rows.groupBy("hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("content").alias("content"))


def read_folder(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """Files of a folder as (hash, content); the first group of ``name`` takes the hash out of a file's path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", name, 1).alias("hash"), "content")


def verified(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): blobs whose content has, or has not, the hash that they are stored under."""
    good = F.sha2(F.col("content"), 256) == F.col("hash")
    return blobs.where(good), blobs.where(F.coalesce(~good, F.lit(True)))


def references(rows: DataFrame) -> DataFrame:
    """Hashes that top-level string columns refer to."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    found = rows.select(F.explode(F.array(*(F.col(f"`{c}`") for c in texts))).alias("r")) if texts else rows.sparkSession.createDataFrame([], "r string")
    return found.where(F.col("r").rlike(f"^{REFERENCE}[0-9a-f]{{64}}$")).select(F.substring("r", len(REFERENCE) + 1, 64).alias("hash")).distinct()


def unreferenced(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """Blobs that nothing refers to."""
    return blobs.join(refs.select("hash"), "hash", "left_anti")


def stats(blobs: DataFrame) -> DataFrame:
    """blobs, bytes (of what is stored) and raw_bytes (of what was given, copies too)."""
    return blobs.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("raw_bytes"))
