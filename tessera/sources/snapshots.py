"""Snapshots of several tables: a Parquet folder each and a manifest with counts and content hashes."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.changelog import violations
from tessera.operators.constraints import Field, Schema, broken, duplicates


class SnapshotIntegrityError(ValueError):
    """A snapshot is not what its manifest says."""


def shared_folder(spark: SparkSession) -> str:
    """A folder for snapshots under ``spark.checkpoint.dir``; only where that is unset a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    return f"{found.rstrip('/')}/snapshots"


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash of them that does not depend on their order: sums of two 64-bit hashes of each row."""
    as_text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    a, b = F.xxhash64(*as_text), F.xxhash64(F.lit(1), *as_text)
    n, x, y = df.agg(F.count(F.lit(1)), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)"))).first()
    return n, f"{x or 0}:{y or 0}"


def save(tables: dict[str, DataFrame], folder: str, label: str = "", *, at: int | None = None, frame: int | None = None, schemas: dict[str, Schema] | None = None) -> str:
    """Writes a snapshot under ``folder`` and returns its id. The manifest is written last: without it there is no snapshot.

    ``at``: its time in milliseconds (now). ``frame``: the last frame of the change log that it holds; a replay goes on after
    it. ``schemas``: what the tables must obey, put back by ``load_schemas``.
    """
    spark = next(iter(tables.values())).sparkSession
    id_ = uuid.uuid4().hex
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{id_}/tables/{name}")
        rows, digest = content_hash(spark.read.parquet(f"{folder}/{id_}/tables/{name}"))
        entries[name] = {"rows": rows, "hash": digest}
    said = {name: asdict(x) for name, x in (schemas or {}).items()}
    manifest = json.dumps({"format": 1, "id": id_, "label": label, "at": int(time.time() * 1000) if at is None else at, "frame": frame, "tables": entries, "schemas": said}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{folder}/{id_}/manifest")
    return id_


def manifest(spark: SparkSession, folder: str, id_: str) -> dict:
    if not re.fullmatch(r"[0-9a-f]{32}", id_):
        raise SnapshotIntegrityError("not the id of a snapshot")
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/{id_}/manifest").collect()))
    except Exception as e:
        raise SnapshotIntegrityError(f"no manifest: {id_}") from e


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of a folder, the newest first: id, label, at, frame, and a map from table to its rows. A snapshot without a manifest was not finished and is not listed."""
    said = F.from_json("value", "id string, label string, at long, frame long, tables map<string, struct<rows: long, hash: string>>")
    rows = spark.read.text(f"{folder}/*/manifest").select(said.alias("m"))
    return rows.select("m.id", "m.label", "m.at", "m.frame", F.transform_values("m.tables", lambda _, t: t["rows"]).alias("tables")).orderBy(F.col("at").desc(), "id")


def load_schemas(spark: SparkSession, folder: str, id_: str) -> dict[str, Schema]:
    """The schemas that a snapshot was saved with."""
    out = {}
    for name, x in manifest(spark, folder, id_).get("schemas", {}).items():
        out[name] = Schema(tuple(Field(**f) for f in x["fields"]), x["primary_key"], tuple(tuple(g) for g in x["unique"]))
    return out


def read_records(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a JSON snapshot file: key, record (JSON text). Entries of the form {id, record}, or records by themselves, whose ``id`` is the key.

    The file is one JSON value, so it is read by one task; it is the form of small, older snapshots. A file that does not
    have the table gives no rows.
    """
    doc = F.parse_json("value")
    rows = spark.read.option("wholetext", True).text(path).select(F.coalesce(F.try_variant_get(doc, f"$.tables.{table}", "array<variant>"), F.try_variant_get(doc, f"$.{table}", "array<variant>")).alias("a"))
    e = rows.select(F.explode("a").alias("e"))
    inner = F.try_variant_get("e", "$.record", "variant")
    return e.select(F.try_variant_get("e", "$.id", "string").alias("key"), F.to_json(F.coalesce(inner, F.col("e"))).alias("record"))


def load(spark: SparkSession, folder: str, id_: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each checked against the manifest."""
    out = {}
    for name, said in manifest(spark, folder, id_)["tables"].items():
        df = spark.read.parquet(f"{folder}/{id_}/tables/{name}")
        if list(content_hash(df)) != [said["rows"], said["hash"]]:
            raise SnapshotIntegrityError(f"table {name} is not what was written")
        out[name] = df
    return out


def rollback(spark: SparkSession, current: dict[str, DataFrame], folder: str, id_: str) -> dict[str, DataFrame]:
    """``current`` with the snapshot's tables put back; tables that are younger than it stay. A damaged snapshot raises and changes nothing."""
    return current | load(spark, folder, id_)


def health(tables: dict[str, DataFrame], *, schemas: dict[str, Schema] | None = None, frames: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """A row per table, and per log and blob store if given: part, name, rows, problems, status (``healthy`` or ``degraded``).

    Problems are rows that break the table's schema (if it has one) and groups that are not unique, frames that break the
    chain, and blobs whose content has another hash.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        schema = (schemas or {}).get(name)
        n = df.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(broken(schema).isNotNull()) if schema else F.lit(0)).cast("long").alias("problems"))
        for group in ((schema.primary_key,), *schema.unique) if schema else ():
            n = n.crossJoin(duplicates(df, group).agg(F.count(F.lit(1)).alias("twice"))).select("rows", (F.col("problems") + F.col("twice")).alias("problems"))  # one row
        parts.append(n.select(F.lit("table").alias("part"), F.lit(name).alias("name"), "rows", "problems"))
    if frames is not None:
        n = frames.agg(F.count(F.lit(1)).alias("rows")).crossJoin(violations(frames).agg(F.count(F.lit(1)).alias("problems")))
        parts.append(n.select(F.lit("log").alias("part"), F.lit("frames").alias("name"), "rows", "problems"))
    if blobs is not None:
        wrong = F.count_if(~(F.sha2("content", 256) == F.col("hash")) | F.col("content").isNull())
        parts.append(blobs.agg(F.count(F.lit(1)).alias("rows"), wrong.alias("problems")).select(F.lit("blobs").alias("part"), F.lit("blobs").alias("name"), "rows", "problems"))
    out = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "part string, name string, rows long, problems long")
    return out.withColumn("status", F.when(F.col("problems") > 0, "degraded").otherwise("healthy"))
