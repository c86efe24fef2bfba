"""The numbered operators as queries over whole tables, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out():
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import media

    got = media.read_media(media.with_media(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_hash")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid

    docs = table(spark, sf_dir, "documents")
    filters = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, filters).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import tokens

    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secrets

    score = secrets.as_column(secrets.train(secrets.labelled_findings(spark)))
    return secrets.findings(table(spark, sf_dir, "documents"), score)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import warc
    from tessera.llm.scratch import new_path

    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    rows = warc.read(spark, path).where("kind = 'record'")
    return rows.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import passages

    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: What SQL can say of an operator's whole result.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             w AS (SELECT page_id, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS first,
                          list_transform(range(8), lambda i: CAST('0x' || substr(sha1(html), CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS g FROM p)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((g[i // 4 + 1] >> CAST(5 * (3 - i % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM w""",
}
