"""SQL conditions with unknown (null) as a third value, where their rules differ from Spark's own, as column functions.

Statements are written in Spark SQL (``select``, with ``?`` parameters) or with these columns; there is no SQL dialect of
the library's own. A row is kept where a condition is true.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BindingsError, ResourceLimitError, SchemaError
from tessera.functions.coerce import ascii_lower, canonical_json
from tessera.operators.predicates import kind_of


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def kind_of_type(kind: T.DataType) -> str:
    return "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "other"


def compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """``=``, ``!=``, ``<``, ``<=``, ``>``, ``>=``: unknown if either side is null or the types differ."""
    if kind_of(value) != kind_of_type(kind):
        return _unknown()
    v = F.lit(value)
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def compare_json(c: Column, op: str, value: str) -> Column:
    """JSON text is equal whatever the order of keys and the form of numbers; equal JSON is also <= and >=, else order is unknown."""
    same = canonical_json(c) == canonical_json(F.lit(value))
    if op in ("=", "!="):
        return same if op == "=" else ~same
    return F.when(same, F.lit(op in ("<=", ">=")))


def is_in(c: Column, kind: T.DataType, values: list[Any], negated: bool = False) -> Column:
    """Values of another type are not equal; with a null among the values, no match is unknown."""
    own = [v for v in values if kind_of(v) == kind_of_type(kind)]
    found = c.isin(own) if own else F.when(c.isNotNull(), F.lit(False))
    if any(v is None for v in values):
        found = F.when(found, True)
    return ~found if negated else found


def between(c: Column, kind: T.DataType, low: Any, high: Any, negated: bool = False) -> Column:
    """Unknown if any of the three is null or of another type, even if the other bound already fails."""
    if kind_of_type(kind) != kind_of(low) or kind_of(low) != kind_of(high):
        return _unknown()
    inside = F.when(c.isNotNull(), c.between(low, high))
    return ~inside if negated else inside


def like(c: Column, pattern: str | None, negated: bool = False) -> Column:
    """``%`` and ``_``; only A to Z fold case; a backslash is an ordinary character."""
    if pattern is None:
        return _unknown()
    folded = "".join(x.lower() if "A" <= x <= "Z" else x for x in pattern)
    subject = ascii_lower(c) if any(x.isascii() and x.isalpha() for x in pattern) else c
    hit = F.like(subject, F.lit(folded), F.lit("\x01"))
    return ~hit if negated else hit


#: Cells that the LIKE tests of one statement may compare.
LIKE_CELLS = 10_000_000


def like_cells(c: Column, pattern: str) -> Column:
    """The work of a naive LIKE, in UTF-16 units as lengths are counted there: one more than the text's, times one more than the pattern's."""
    units = F.octet_length(F.encode(c, "UTF-16BE")) / 2
    return ((units + 1) * (len(pattern.encode("utf-16-be")) // 2 + 1)).cast("long")


def within_budget(df: DataFrame, tests: list[tuple[Column, str]], most: int = LIKE_CELLS) -> DataFrame:
    """``df``, or ResourceLimitError if LIKE tests (column, pattern) of all its rows take more than ``most`` cells."""
    total = reduce(lambda a, b: a + b, (F.coalesce(like_cells(c, p), F.lit(0)) for c, p in tests))
    cells = df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]
    if cells > most:
        raise ResourceLimitError(f"LIKE takes {cells} cells of {most}")
    return df


def order_by(df: DataFrame, keys: list[tuple[str, str]], *, last: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Nulls first ascending, last descending; ``last`` breaks ties. A negative limit is none, a negative offset 0."""
    sort = [F.col(n).desc_nulls_last() if d.lower() == "desc" else F.col(n).asc_nulls_first() for n, d in keys]
    out = df.orderBy(*sort, *([F.col(last).asc()] if last else [])) if sort else df
    out = out.offset(offset) if offset and offset > 0 else out
    return out.limit(limit) if limit is not None and limit >= 0 else out


def variant_order(c: Column) -> list[Column]:
    """Sort keys of a VARIANT column: null, numbers, booleans, strings, then anything else as equal."""
    shape = F.schema_of_variant(c)
    get = lambda kind: F.try_variant_get(c, "$", kind)
    rank = F.when(c.isNull() | F.is_variant_null(c), 0).when(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), 1).when(shape == "BOOLEAN", 2).when(shape == "STRING", 3).otherwise(4)
    return [rank, F.when(rank == 1, get("double")), F.when(rank == 2, get("boolean")), F.when(rank == 3, get("string"))]


#: String literals, quoted names and comments of Spark SQL, in which a name in braces is none.
_NAMES = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\{(\w+)\}""", re.S)


def select(spark: SparkSession, statement: str, parameters: list[Any] | None = None, **views: DataFrame) -> DataFrame:
    """A Spark SQL statement with positional ``?`` over DataFrames given by name (``{name}`` in the statement, but not within quotes).

    SchemaError for a name that is not given and for output names that repeat; BindingsError for a wrong number of parameters.
    """
    own = {name: f"v{uuid.uuid4().hex}" for name in views}

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in own:
            raise SchemaError(f"unknown table {m[1]}")
        return own[m[1]]

    statement = _NAMES.sub(put, statement)
    marks = len(re.findall(r"\?", re.sub(_NAMES, "", statement)))
    if marks != len(parameters or []):
        raise BindingsError(f"{marks} parameters are needed, {len(parameters or [])} given")
    try:
        for name, df in views.items():
            df.createTempView(own[name])
        out = spark.sql(statement, args=parameters or None)
    finally:
        for name in own.values():
            spark.catalog.dropTempView(name)
    if len({c.lower() for c in out.columns}) < len(out.columns):
        raise SchemaError(f"output names repeat: {out.columns}")
    return out


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)
