"""Value rules of dynamically typed records as column functions: numeric coercion, canonical JSON, case folding, differences."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space around a number in a string.
SPACE = r"[\s\x{feff}\h\v]"
_DECIMAL = rf"^{SPACE}*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?{SPACE}*$"
_INFINITE = rf"^{SPACE}*([+-]?)Infinity{SPACE}*$"


def strip(c: Column) -> Column:
    """``c`` without leading and trailing white space of any kind, line ends and byte-order marks too."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def number_of_text(c: Column) -> Column:
    """The number that a string stands for: blank is 0, decimal and exponent forms, signed Infinity, 0x, 0o and 0b; else null."""
    bare = strip(c)
    radix = reduce(
        lambda done, x: done.when(bare.rlike(x[0]), F.conv(F.substring(bare, 3, 64), x[1], 10).cast("double")),
        (("^0[oO][0-7]+$", 8), ("^0[bB][01]+$", 2)),
        F.when(bare.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(bare, 3, 64), 16, 10).cast("double")),
    )
    return (
        radix.when(bare == "", F.lit(0.0))
        .when(c.rlike(_INFINITE), F.when(bare.startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf)))
        .when(c.rlike(_DECIMAL), bare.try_cast("double"))
    )


def js_number(c: Column, kind: T.DataType, null: float | None = 0.0) -> Column:
    """``c`` as a double, null where it is not a number. ``null``: what an explicit null counts as."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = F.when(c == F.lit(float("nan")), F.lit(None).cast("double")).when(c.isNotNull(), c.cast("double"))
    elif isinstance(kind, T.NumericType):
        x = c.cast("double")
    elif isinstance(kind, T.BooleanType):
        x = c.cast("int").cast("double")
    elif isinstance(kind, T.StringType):
        x = number_of_text(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        x = F.unix_millis(c.cast("timestamp")).cast("double")
    else:
        x = F.lit(None).cast("double")
    return x if null is None else F.when(c.isNull(), F.lit(float(null))).otherwise(x)


def rounded4(x: Column) -> Column:
    """Four decimals, halves up. Values too large for that (or infinite) stay as they are."""
    return F.when(F.abs(x) < F.lit(9e14), F.floor(x * 10000 + 0.5) / F.lit(10000.0)).otherwise(x)


def ascii_lower(c: Column) -> Column:
    """A to Z in lower case, every other character unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_numbers(json: Column) -> Column:
    """JSON text with whole numbers in one form: 1.0 is 1."""
    return F.regexp_replace(json, r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0+(?![\d.eE])', "$1$2")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted object keys and numbers of one form (1.0 and 1e0 are 1); null if it is not JSON."""
    return plain_numbers(F.to_json(F.try_parse_json(text)))


def row_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key`` and ``diff``: for every row of a key that both have and that changed, a map from field to (old, new) as text."""
    fields = [c for c in before.columns if c != key and c in after.columns]
    both = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    changed = F.filter(
        F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("old"), F.col(f"a.{f}").cast("string").alias("new"), (~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))).alias("differs")) for f in fields)),
        lambda x: x["differs"],
    )
    pairs = F.map_from_entries(F.transform(changed, lambda x: F.struct(x["field"], F.struct(x["old"].alias("old"), x["new"].alias("new")))))
    return both.select(F.col(f"b.{key}").alias(key), pairs.alias("diff")).where(F.size("diff") > 0)
