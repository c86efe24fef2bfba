"""Text compaction and token estimates for prompts, as column functions and conversation aggregates."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.coerce import strip


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for an empty or null text."""
    units = F.length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2
    return F.ceil(units / 4).cast("long")


def normalise(text: Column, role: Column | None = None) -> Column:
    """CRLF to LF; for the role ``system`` runs of blanks to one; else three or more line ends to two and runs of blanks to one; then trimmed."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    system = strip(F.regexp_replace(plain, "[ \t]+", " "))
    other = strip(F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), "[ \t]{2,}", " "))
    return other if role is None else F.when(role == "system", system).otherwise(other)


def normalise_blocks(blocks: Column, role: Column | None = None, *, nested: bool = False) -> Column:
    """Structured content, an array of (type, text, signature): the text of ``text`` and ``tool_result`` blocks and of unsigned ``thinking`` blocks is normalised, all else is left alone.

    ``nested``: blocks have a field ``content``, an array of such blocks, which is treated alike in ``tool_result`` blocks.
    """
    change = lambda b: b["type"].isin("text", "tool_result") | ((b["type"] == "thinking") & b["signature"].isNull())

    def one(b: Column) -> Column:
        out = b.withField("text", F.when(change(b), normalise(b["text"], role)).otherwise(b["text"]))
        return out.withField("content", F.when(b["type"] == "tool_result", normalise_blocks(b["content"], role)).otherwise(b["content"])) if nested else out

    return F.transform(blocks, one)


def compacted(messages: DataFrame, *, role: str = "role", text: str = "text", system: str | None = None) -> DataFrame:
    """``messages`` with their texts (and the column ``system``, a conversation's system prompt) normalised: what is sent in their place."""
    out = messages.withColumn(text, normalise(F.col(text), F.col(role)))
    return out.withColumn(system, normalise(F.col(system), F.lit("system"))) if system else out


def compact(messages: DataFrame, *, conversation: str = "conv_id", role: str = "role", text: str = "text", system: str | None = None) -> DataFrame:
    """Per conversation: tokens_before, tokens_after, tokens_saved, percent_saved (of those before, two decimals; 0 where there are none).

    ``system``: a column with the conversation's system prompt, the same in all its rows; it counts once.
    """
    after = normalise(F.col(text), F.col(role))
    sums = messages.groupBy(conversation).agg(F.sum(estimate_tokens(F.col(text))).alias("b"), F.sum(estimate_tokens(after)).alias("a"), *([F.max(system).alias("s")] if system else []))
    before, after = F.col("b"), F.col("a")
    if system:
        before, after = before + estimate_tokens(F.col("s")), after + estimate_tokens(normalise(F.col("s"), F.lit("system")))
    sums = sums.select(conversation, before.alias("tokens_before"), after.alias("tokens_after"), F.greatest(before - after, F.lit(0)).cast("long").alias("tokens_saved"))
    percent = F.when(F.col("tokens_before") > 0, F.floor(F.col("tokens_saved") / F.col("tokens_before") * 100 * 100 + 0.5) / 100).otherwise(F.lit(0.0))
    return sums.withColumn("percent_saved", percent.cast("double"))


def prompt_hash(messages: DataFrame, *, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", system: str | None = None) -> DataFrame:
    """Per conversation the SHA-256 of its system prompt (null without a column ``system``) and messages as JSON, in their order: ``prompt_sha256``.

    The hash runs over a conversation's sorted rows a batch at a time, so one of any length takes the memory of a batch.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    one = F.concat(F.lit('{"role":'), quoted(role), F.lit(',"content":'), quoted(text), F.lit("}"))
    given = F.when(F.col(system).isNotNull(), quoted(system)).otherwise(F.lit("null")) if system else F.lit("null")
    kind = messages.schema[conversation].dataType.simpleString()

    def run(batches):
        now, digest = None, None  # now: a tuple of the conversation at hand
        for batch in batches:
            done = []
            for of, head, message in zip(*(batch.column(c).to_pylist() for c in ("of", "head", "message")), strict=True):
                if now != (of,):
                    if digest is not None:
                        digest.update(b"]}")
                        done.append((now[0], digest.hexdigest()))
                    now, digest = (of,), hashlib.sha256(f'{{"systemPrompt":{head},"messages":['.encode())
                else:
                    digest.update(b",")
                digest.update(message.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("of").type), pa.array([d[1] for d in done], pa.string())], ["of", "sha"])
        if digest is not None:
            digest.update(b"]}")
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.schema.field("of").type), pa.array([digest.hexdigest()])], ["of", "sha"])

    rows = messages.select(F.col(conversation).alias("of"), F.col(order).alias("nth"), given.alias("head"), one.alias("message"))
    hashed = rows.repartition("of").sortWithinPartitions("of", "nth", "message").select("of", "head", "message").mapInArrow(run, f"of {kind}, sha string")
    return hashed.select(F.col("of").alias(conversation), F.col("sha").alias("prompt_sha256"))


def cached_prompts(hashes: DataFrame, *, conversation: str = "conv_id", digest: str = "prompt_sha256") -> DataFrame:
    """``hashes`` with ``cached``: whether an earlier conversation had the same prompt. The first is found by an aggregate, so a common prompt is no hot window."""
    first = hashes.groupBy(digest).agg(F.min(conversation).alias("__first"))
    return hashes.join(first, digest).select(*hashes.columns, (F.col(conversation) > F.col("__first")).alias("cached"))
