"""Declared schemas: types, NOT NULL, defaults, unique groups, checked as set operations on whole tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConstraintError

_SPARK = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BOOLEAN": "boolean", "JSON": "string", "ANY": "string"}
_SAFE = 2**53 - 1


__all__ = ["ConstraintError", "Field", "Schema", "broken", "checked", "duplicates", "filled"]
_TYPES = {"TEXT": T.StringType, "INTEGER": T.IntegralType, "REAL": T.NumericType, "BOOLEAN": T.BooleanType, "JSON": T.StringType, "ANY": T.StringType}


@dataclass(frozen=True)
class Field:
    """``kind``: TEXT, INTEGER, REAL, BOOLEAN, JSON or ANY (both JSON text)."""

    name: str
    kind: str
    nullable: bool = True
    default: Any = None


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    primary_key: str
    unique: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ConstraintError("two columns of one name")
        key = [f for f in self.fields if f.name == self.primary_key]
        if len(key) != 1 or key[0].kind not in ("TEXT", "INTEGER") or key[0].default is not None:
            raise ConstraintError("one primary key of TEXT or INTEGER without a default is needed")
        kinds = {f.name: f.kind for f in self.fields}
        for group in self.unique:
            if any(kinds.get(c) in (None, "JSON", "ANY") for c in group):
                raise ConstraintError("unique columns must be declared and scalar")


def filled(df: DataFrame, schema: Schema) -> DataFrame:
    """The declared columns in their order; a column that the rows lack has its default. An explicit null stays null. Types are checked, not cast: a string is no INTEGER."""
    unknown = [c for c in df.columns if c not in {f.name for f in schema.fields}]
    if unknown:
        raise ConstraintError(f"columns that are not declared: {unknown}")
    for f in schema.fields:
        if f.name in df.columns and not isinstance(df.schema[f.name].dataType, (_TYPES[f.kind], T.NullType)):
            raise ConstraintError(f"{f.name} must be {f.kind}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(f.default)).cast(_SPARK[f.kind]).alias(f.name) for f in schema.fields))


def broken(schema: Schema) -> Column:
    """Why a row breaks the schema, null if it does not."""
    tests = []
    for f in schema.fields:
        c = F.col(f.name)
        if not f.nullable or f.name == schema.primary_key:
            tests.append((c.isNull(), f"{f.name} is null"))
        if f.kind == "INTEGER":
            tests.append((F.abs(c) > _SAFE, f"{f.name} is out of range"))
        elif f.kind == "REAL":
            tests.append(((c == F.lit(float("nan"))) | (F.abs(c) == F.lit(float("inf"))), f"{f.name} is not finite"))
        elif f.kind in ("JSON", "ANY"):
            tests.append((c.isNotNull() & F.try_parse_json(c).isNull(), f"{f.name} is not JSON"))
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def duplicates(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Groups of ``columns`` that more than one row has; a group with a null in it is no duplicate. Counted before the shuffle."""
    full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.where(full).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(df: DataFrame, schema: Schema) -> DataFrame:
    """``filled(df)``, or ConstraintError with an example. Checks the rows as they end up, so two rows may swap unique values in one change."""
    rows = filled(df, schema)
    bad = rows.withColumn("__why", broken(schema)).where("__why is not null").select("__why").limit(1).collect()
    if bad:
        raise ConstraintError(bad[0][0])
    for group in ((schema.primary_key,), *schema.unique):
        if twice := duplicates(rows, group).limit(1).collect():
            raise ConstraintError(f"more than one row has {twice[0].asDict()}")
    return rows
