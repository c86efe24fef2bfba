"""Change logs as tables of frames: hash chains, replay to current rows, field differences, expiry.

A frame is (frame_id, ts, op, table, key, payload, checksum, previous): op is INSERT, UPDATE, DELETE, CLEAR (of a whole
table) or a mark without effect; payload is the record as JSON text. The checksum is the SHA-256 of the fields before it,
joined by colons, with the payload's own bytes and the previous frame's checksum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.coerce import plain_numbers

GENESIS = "0" * 64
FRAME = T.StructType([T.StructField(n, T.LongType() if n in ("frame_id", "ts") else T.StringType()) for n in ("frame_id", "ts", "op", "table", "key", "payload", "checksum", "previous")])


class LogIntegrityError(ValueError):
    """A change log does not hold what its chain says."""


OPERATIONS = ("INSERT", "UPDATE", "DELETE", "CLEAR", "CHECKPOINT", "ROLLBACK", "BRANCH_MERGE")
#: Frames of consecutive numbers that one window may hold: a key or table with a large share of all frames is cut by this.
SPAN = 1 << 18


def checksum(previous: Column) -> Column:
    """The checksum of a frame after ``previous``; null if one of its fields (but the payload) is."""
    fields = [F.col(c).cast("string") for c in ("frame_id", "ts", "op", "table", "key")]
    parts = [*fields, F.coalesce("payload", F.lit("{}")), previous]
    joined = reduce(lambda a, b: F.concat(a, F.lit(":"), b), parts)
    return F.sha2(joined.cast("binary"), 256)


def read_frames(spark, path: str) -> DataFrame:
    """JSON lines as frames, blank lines left out. ``payload`` keeps its own text.

    A line that is no frame has null fields and itself in ``line``. ``unfinished`` marks the last line of a file that does not end
    with a line end: the lines of such a file, each with a line end, have one byte more than the file.
    """
    meta = {"file": "_metadata.file_path", "size": "_metadata.file_size", "block": "_metadata.file_block_start"}
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), *(F.col(c).alias(a) for a, c in meta.items())).withColumn("nth", F.monotonically_increasing_id())
    ends = lines.groupBy("file").agg(F.max("size").alias("size"), F.sum(F.octet_length("line") + 1).alias("read"), F.max(F.struct("block", "nth")).alias("last"))
    open_ = ends.where("read > size").select("file", "last")
    lines = lines.join(open_, "file", "left").withColumn("unfinished", F.coalesce(F.col("last") == F.struct("block", "nth"), F.lit(False))).where("trim(line) <> ''")
    parsed = F.from_json("line", "frame_id long, ts long, op string, `table` string, key string, checksum string, previous string")
    payload = F.nullif(F.regexp_extract("line", r'(?s)"payload":(.*),"checksum":"', 1), F.lit(""))
    return lines.select(parsed.alias("f"), payload.alias("payload"), "line", "unfinished").select("f.frame_id", "f.ts", "f.op", "f.table", "f.key", "payload", "f.checksum", "f.previous", "line", "unfinished")


def torn_tail(lines: DataFrame) -> DataFrame:
    """Frames as ``read_frames`` gives them, without a last line that was cut off while it was written.

    Only the last line of a file goes, only if it has no line end, and only if it is no JSON. Any other line that is no
    frame stays, and ``violations`` names it.
    """
    return lines.where(~(F.col("unfinished") & F.try_parse_json("line").isNull()))


def violations(frames: DataFrame) -> DataFrame:
    """Frames that break the chain: frame_id and ``why``, the first that applies of form, op, twice, gap, link and checksum.

    form: a field (but payload and previous) is null, the number is below 1 or the payload no JSON object. twice: another
    frame has this number (each is named). Each frame is joined with its predecessor by number, so a long log is checked in
    parallel, not in one ordered task. The first frame follows none: its link is 64 zeros, or left out, as any link may be.
    """
    needed = [F.col(c).isNull() for c in ("frame_id", "ts", "op", "table", "key", "checksum")]
    object_ = F.col("payload").isNull() | F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    form = reduce(lambda a, b: a | b, needed) | (F.col("frame_id") < 1) | ~object_
    bad, good = frames.where(form).select("frame_id", F.lit("form").alias("why")), frames.where(~form)
    known = good.groupBy("frame_id").agg(F.count(F.lit(1)).alias("__n"), F.min("checksum").alias("__own"))
    low = good.agg(F.min("frame_id").alias("__low"))
    before = known.select((F.col("frame_id") + 1).alias("frame_id"), F.col("__own").alias("__before"))
    rows = good.join(known.select("frame_id", "__n"), "frame_id").join(before, "frame_id", "left").crossJoin(low)  # one row
    first = F.col("frame_id") == F.col("__low")
    expected = F.when(first, F.lit(GENESIS)).otherwise(F.col("__before"))
    why = (
        F.when(~F.col("op").isin(*OPERATIONS), "op")
        .when(F.col("__n") > 1, "twice")
        .when(~first & F.col("__before").isNull(), "gap")
        .when(F.col("previous").isNotNull() & (F.col("previous") != expected), "link")
        .when(F.coalesce(F.col("checksum") != checksum(expected), F.lit(True)), "checksum")
    )
    return rows.select("frame_id", why.alias("why")).where("why is not null").union(bad)


def verified(frames: DataFrame) -> DataFrame:
    """``frames``, or LogIntegrityError that names the first frame that breaks the chain."""
    bad = violations(frames).orderBy(F.col("frame_id").asc_nulls_first()).limit(1).collect()
    if bad:
        raise LogIntegrityError(f"frame {bad[0]['frame_id']}: {bad[0]['why']}")
    return frames


def replay(frames: DataFrame) -> DataFrame:
    """Current rows (table, key, payload, frame_id, inserted): the last write of each key after its table's last CLEAR, unless it is a delete.

    ``inserted`` is the frame of the row's first write since it was last absent: the order of insertion. The last write is
    taken by an aggregate, so a key with very many frames is reduced before the shuffle.
    """
    writes = frames.where(F.col("op").isin("INSERT", "UPDATE", "DELETE"))
    clears = frames.where("op = 'CLEAR'").groupBy("table").agg(F.max("frame_id").alias("__clear"))
    live = writes.join(clears, "table", "left").where("__clear is null or frame_id > __clear")  # a row for each table
    last = live.groupBy("table", "key").agg(
        F.max(F.struct("frame_id", "op", "payload")).alias("w"),
        F.max(F.when(F.col("op") == "DELETE", F.col("frame_id"))).alias("gone"),
    )
    last = last.where("w.op <> 'DELETE'")
    born = live.join(last.select("table", "key", "gone"), ["table", "key"]).where("gone is null or frame_id > gone").groupBy("table", "key").agg(F.min("frame_id").alias("inserted"))
    return last.join(born, ["table", "key"]).select("table", "key", F.col("w.payload").alias("payload"), F.col("w.frame_id").alias("frame_id"), "inserted")


def compacted(frames: DataFrame, now: int) -> DataFrame:
    """The log of a new generation: ``replay``'s rows as INSERT frames in their order of insertion, numbered after the last frame (frame_id, ts, op, table, key, payload).

    Replaying it gives the same rows in the same order. Numbers are dealt without one ordered task: within ranges of the
    order, behind the count of the ranges before.
    """
    rows = replay(frames).withColumn("__chunk", F.floor(F.col("inserted") / SPAN))
    before = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    top = frames.agg(F.coalesce(F.max("frame_id"), F.lit(0)).alias("__top"))
    own = F.row_number().over(Window.partitionBy("__chunk").orderBy("inserted", "table", "key"))
    return rows.join(before, "__chunk").crossJoin(top).select((F.col("__top") + F.col("__base") + own).alias("frame_id"), F.lit(now).cast("long").alias("ts"), F.lit("INSERT").alias("op"), "table", "key", "payload")


def with_before(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """Writes (INSERT, UPDATE, DELETE) with ``before``: the key's record until then, null where it was absent (a CLEAR of its table makes it so).

    Frames are ordered in windows of at most ``span`` consecutive numbers; what a key and a table had before a window comes
    from an aggregate, so no key, however hot, is one task's work.
    """
    rows = frames.where(F.col("op").isin("INSERT", "UPDATE", "DELETE", "CLEAR")).withColumn("__chunk", F.floor(F.col("frame_id") / span))
    # the last CLEAR of the table before each frame
    cleared = F.when(F.col("op") == "CLEAR", F.col("frame_id"))
    rows = rows.withColumn("__clear", F.max(cleared).over(Window.partitionBy("table", "__chunk").orderBy("frame_id")))
    earlier = rows.groupBy("table", "__chunk").agg(F.max(cleared).alias("__id"))
    earlier = earlier.withColumn("__earlier", F.max("__id").over(Window.partitionBy("table").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__id")
    rows = rows.where("op <> 'CLEAR'").join(earlier, ["table", "__chunk"]).withColumn("__clear", F.coalesce("__clear", "__earlier", F.lit(-1)))
    # the key's frame before it
    write = F.struct("frame_id", "op", "payload")
    rows = rows.withColumn("__own", F.lag(write).over(Window.partitionBy("table", "key", "__chunk").orderBy("frame_id")))
    last = rows.groupBy("table", "key", "__chunk").agg(F.max(write).alias("__last"))
    last = last.withColumn("__prior", F.lag("__last").over(Window.partitionBy("table", "key").orderBy("__chunk"))).where("__prior is not null").select("table", "key", "__chunk", "__prior")
    rows = rows.join(last, ["table", "key", "__chunk"], "left").withColumn("__was", F.coalesce("__own", "__prior"))
    there = (F.col("__was.op") != "DELETE") & (F.col("__was.frame_id") > F.col("__clear"))
    return rows.withColumn("before", F.when(there, F.col("__was.payload"))).select(*frames.columns, "before")


def differences(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """For every write of a key that was there: frame_id, table, key, and by field the (old, new) JSON that changed; none for a write without changes.

    Values are compared as JSON, so 1 is not "1" and a null is not an absent field, which is null here. 1 and 1.0 are equal.
    """
    fields = lambda c: F.transform_values(F.from_json(c, "map<string,variant>"), lambda _, v: plain_numbers(F.to_json(v)))
    rows = with_before(frames, span).where("before is not null and payload is not null and op <> 'DELETE'").select("frame_id", "table", "key", fields("before").alias("o"), fields("payload").alias("n"))
    names = F.array_sort(F.array_union(F.map_keys("o"), F.map_keys("n")))
    changed = F.filter(names, lambda k: ~F.col("o")[k].eqNullSafe(F.col("n")[k]))
    diff = F.map_from_entries(F.transform(changed, lambda k: F.struct(k, F.struct(F.col("o")[k].alias("old"), F.col("n")[k].alias("new")))))
    return rows.select("frame_id", "table", "key", diff.alias("diff")).where(F.size("diff") > 0)


def live_rows(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired at ``now``; a null expiry never comes."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def expired_events(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """The rows that ``live_rows`` leaves out, as EXPIRE events."""
    return rows.where(F.col(expires).isNotNull() & (F.col(expires) <= now)).withColumn("op", F.lit("EXPIRE"))
