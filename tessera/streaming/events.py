"""Change events as a stream: a folder of frame files read by Structured Streaming, filtered, handed to a callback or a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.changelog import FRAME
from tessera.operators.predicates import DocumentFields, matches


def stream(spark: SparkSession, folder: str, where: dict[str, Any] | None = None, files: int = 64) -> DataFrame:
    """Frames of the JSON files in ``folder`` as they come.

    ``where`` filters by the record: a frame whose record is known and does not match is left out. CLEAR, and a DELETE that
    carries no record, always pass (``with_before`` knows the record that a DELETE removes).
    """
    frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files).json(folder)
    return matching(frames, where) if where else frames


def matching(frames: DataFrame, where: dict[str, Any]) -> DataFrame:
    """Frames whose record (``payload``, else ``before`` if there is such a column) matches, or is not known."""
    record = F.coalesce("payload", "before") if "before" in frames.columns else F.col("payload")
    rows = frames.withColumn("__doc", F.try_parse_json(record))
    return rows.where((F.col("op") == "CLEAR") | F.col("__doc").isNull() | matches(DocumentFields("__doc"), where)).drop("__doc")


_STATE = "tables array<string>, keys array<string>, payloads array<string>, ends array<long>"
_EVENT = "frame_id long, ts long, op string, `table` string, key string, payload string, before string"
#: Keys are dealt to so many groups, each with one state: a call of Python for each key would cost more than its frames.
GROUPS = 1024


def with_before(frames: DataFrame, expires: str | None = None, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Writes with the record that their key had ``before``, kept as state: frame_id, ts, op, table, key, payload, before.

    ``expires``: the field of a record with the time in milliseconds at which it ends. Once the stream's time (the largest
    ``ts`` less ``late``) has passed it, an event of op EXPIRE (frame_id null, ts the end, the record in ``before``) is
    given and the record forgotten; a write without the field ends it never. The frames of a micro-batch are taken in their
    order. Frames whose ``ts`` is not after the stream's time are late and left out; a CLEAR is of no key and is not seen.
    The records of all keys of a group are one state, written anew with every micro-batch that has frames of it; ``groups``
    stays as it is while a checkpoint is in use.
    """

    def step(_, batches, state):
        kept = {(t, k): (p, e) for t, k, p, e in zip(*state.get, strict=True)} if state.exists else {}
        now, out, written_now = state.getCurrentWatermarkMs(), [], set()

        def ended(name):
            payload, end = kept.pop(name)
            out.append((None, end, "EXPIRE", *name, None, payload))

        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values("frame_id", kind="stable")
            whole = lambda c: [None if n else int(v) for v, n in zip(rows[c].tolist(), rows[c].isna().tolist(), strict=True)]
            names = zip(rows["table"].tolist(), rows["key"].tolist(), strict=True)
            for frame, ts, op, name, payload, end in zip(whole("frame_id"), whole("ts"), rows["op"].tolist(), names, rows["payload"].tolist(), whole("end"), strict=True):
                before, until = kept.get(name, (None, None))
                if until is not None and until <= ts:  # it ended before this write
                    ended(name)
                    before = None
                out.append((frame, ts, op, *name, payload, before))
                written_now.add(name)
                if op == "DELETE" or payload is None:
                    kept.pop(name, None)
                else:
                    kept[name] = (payload, end)
        for name in [n for n, (_, end) in kept.items() if end is not None and end < now and n not in written_now]:
            ended(name)
        if kept:
            state.update(tuple(map(list, zip(*((*name, *record) for name, record in kept.items()), strict=True))))
            ends = [end for _, end in kept.values() if end is not None]
            if ends:
                state.setTimeoutTimestamp(max(min(ends), now + 1))
        elif state.exists:
            state.remove()
        table = pd.DataFrame(out, columns=["frame_id", "ts", "op", "table", "key", "payload", "before"])
        yield table.astype({"frame_id": "Int64", "ts": "Int64"})

    end = F.try_variant_get(F.try_parse_json("payload"), f"$.{expires}", "long") if expires else F.lit(None).cast("long")
    group = F.pmod(F.xxhash64("table", "key"), F.lit(groups)).cast("int").alias("group")
    rows = frames.where(F.col("op").isin("INSERT", "UPDATE", "DELETE")).select("frame_id", "ts", "op", "table", "key", "payload", end.alias("end"), F.timestamp_millis("ts").alias("time"), group).withWatermark("time", late)
    return rows.groupBy("group").applyInPandasWithState(step, _EVENT, _STATE, "append", "EventTimeTimeout")


def subscribe(events: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False):
    """Calls ``callback(batch, number)`` for every micro-batch; each is delivered at least once, with the same number if again."""
    writer = events.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(events: DataFrame) -> DataFrame:
    """The last write of every key so far, as a streaming aggregate: table, key, frame_id, op, payload. Spark's state holds one row for each key; deletes stay as such."""
    writes = events.where(F.col("op").isin("INSERT", "UPDATE", "DELETE"))
    last = writes.groupBy("table", "key").agg(F.max(F.struct("frame_id", "op", "payload")).alias("w"))
    return last.select("table", "key", "w.frame_id", "w.op", "w.payload")


def written(events: DataFrame, table: str, checkpoint: str, *, mode: str = "append") -> None:
    """Runs ``events`` over what has come so far into a Parquet table, exactly once; ``mode`` complete (for ``current``) writes it anew with every micro-batch."""
    if mode == "append":
        events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return
    whole = lambda batch, _: batch.write.mode("overwrite").parquet(table)
    events.writeStream.outputMode(mode).foreachBatch(whole).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
