"""The corpus pipeline: documents in, packed sequences out, in five stages that each call one operator of ``tessera.llm``.

Every stage reads the Parquet that its predecessor wrote and works on all of it:

1. ``language_id``: filters are learned from the labelled documents (those that are not held out); documents without a
   letter go, and so do those of enough n-grams of which hardly any belong to a language that was learned.
2. ``near_duplicates``: of each group linked by a shingle similarity of 0.8 or more, the document with the smallest id stays.
3. ``decontamination``: documents that overlap a benchmark item go.
4. ``secrets``: found secrets are replaced by a mark in the text; every document stays.
5. ``packing``: the token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, packing, secrets
from tessera.llm.queries import held_out, table, tokenizer_path
from tessera.llm.scratch import written

#: A document goes if it has so many n-grams or more and a score below this.
MIN_GRAMS, MIN_SCORE = 50, 0.2


def placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns named by their places, so that none clashes with an operator's own, and the names of its id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known, or too short to say. A null or empty text, or one without a letter, goes; a null id, rows that repeat and any other column stay as they are. An empty table stays one."""
    filters = langid.fit(docs.where(~held_out()))
    rows, id, text = placed(docs)
    known = langid.identify(rows, filters, id=id, text=text, keep=tuple(c for c in rows.columns if c != id))
    good = (F.col("lang_pred") != "und") & ((F.col("n_grams") < MIN_GRAMS) | (F.col("score") >= MIN_SCORE))
    return known.where(good).select(*rows.columns).toDF(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` by place with ``key``, id and hash of the text, which tells rows apart whose ids are null or repeat; and key and text alone."""
    rows, id, text = placed(docs)
    rows = rows.withColumn("key", F.struct(F.col(id).alias("i"), F.xxhash64(text).alias("h")))
    return rows, rows.select("key", F.col(text).alias("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: of those of the least id (a null is the least) one row. A null or wordless text has no group and stays; rows equal in id and text count as one document."""
    rows, texts = keyed(docs)
    groups = written(jaccard.near_duplicates(texts, id="key"), "groups")
    gone = groups.where("not class_id <=> key").select("key").distinct()
    rows = rows.join(gone, "key", "left_anti")
    repeated = groups.groupBy("key").count().where("count > 1").limit(1).count()
    return (rows.dropDuplicates(["key"]) if repeated else rows).drop("key").toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item. Null and empty texts overlap none; rows that repeat stay or go together."""
    rows, texts = keyed(docs)
    found = decontam.leaks(texts, table(spark, sf_dir, "benchmark"), id="key").select("key").distinct()
    return rows.join(written(found, "leaks"), "key", "left_anti").drop("key").toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and ``n_chars`` as the texts are then. Null texts stay null."""
    score = secrets.as_column(secrets.train(secrets.labelled_findings(spark)))
    rows = secrets.redacted(docs, score)
    rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
    return rows.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, one row each: see ``packing.pack``. A null text is an empty one, whose piece is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", packed)]

#: SQL has no Bloom filters, trained forest or library tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the Parquet that its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
