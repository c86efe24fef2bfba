"""Filters on records: a dictionary of conditions to one Spark column.

Rules of comparison are those of dynamically typed records: equality is strict in type, order compares numbers and
strings with the usual coercions, and values that cannot be compared pass an ordering test. A condition is never null, so
its negation is its complement. Same-type comparisons stay bare (``c > v`` behind ``c IS NOT NULL``) and are pushed to the
scan.

``TypedFields`` reads columns of a schema: a column is always present and null is an explicit null. ``DocumentFields`` reads
one VARIANT column: a field may be absent, null, or of any type, row by row.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.coerce import js_number, number_of_text

OPERATORS = ("$eq", "$ne", "$exists", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$between", "$startsWith", "$endsWith", "$contains", "$regex")
_NAN = float("nan")


def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)



class Missing:
    """Stands for "no value at all", as opposed to None."""

    def __repr__(self) -> str:
        return "MISSING"


MISSING = Missing()


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.date, dt.datetime)):
        return "date"
    return "other"


def _number(value: Any) -> float:
    """A literal as a number; NaN if it is none."""
    kind = kind_of(value)
    if kind == "null":
        return 0.0
    if kind in ("number", "boolean"):
        return float(value)
    if kind == "date":
        moment = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        return (moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000
    if kind == "string":
        text = value.strip()
        if not text:
            return 0.0
        for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
            if text.lower().startswith(prefix):
                try:
                    return float(int(text[2:], base))
                except ValueError:
                    return _NAN
        if re.fullmatch(r"[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", text):
            return float(text.replace("Infinity", "inf"))
    return _NAN


@dataclass(frozen=True)
class Value:
    """One field in the rows: is it there, is it null (or not there), and its value by kind (None where it never is of that kind)."""

    exists: Column
    empty: Column
    by_kind: dict[str, Column]
    null_number: float = 0.0
    floating: bool = False
    open_kinds: bool = False

    def of(self, kind: str) -> Column | None:
        return self.by_kind.get(kind)


class TypedFields:
    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def value(self, name: str) -> Value | None:
        if name not in self.types:
            return None
        kind, c = self.types[name], F.col(f"`{name}`")
        if isinstance(kind, T.BooleanType):
            own = {"boolean": c}
        elif isinstance(kind, T.NumericType):
            own = {"number": c}
        elif isinstance(kind, T.StringType):
            own = {"string": c}
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            own = {"date": c}
        else:
            own = {}
        return Value(_true(), c.isNull(), own, floating=isinstance(kind, (T.FloatType, T.DoubleType)))


class DocumentFields:
    def __init__(self, column: str):
        self.column = column

    def _at(self, name: str, kind: str) -> Column:
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        return F.try_variant_get(F.col(self.column), path, kind)

    def raw(self, name: str) -> Column:
        """The field as VARIANT, null where a record lacks it."""
        return self._at(name, "variant")

    def value(self, name: str) -> Value:
        at = lambda kind: self._at(name, kind)
        raw = self.raw(name)
        shape = F.schema_of_variant(raw)
        own = {
            "number": F.when(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), at("double")),
            "string": F.when(shape == "STRING", at("string")),
            "boolean": F.when(shape == "BOOLEAN", at("boolean")),
        }
        return Value(raw.isNotNull(), raw.isNull() | F.is_variant_null(raw), own, open_kinds=True)


def _explicit_null(v: Value) -> Column:
    return v.exists & v.empty if v.open_kinds else v.empty


def equals(v: Value | None, value: Any) -> Column:
    """Strictly the same value; None is an explicit null, MISSING no value."""
    if v is None or value is MISSING:
        return _true() if v is None and value is MISSING else _false() if v is None else ~v.exists
    kind = kind_of(value)
    if kind == "null":
        return _explicit_null(v)
    c = v.of(kind)
    if c is None or kind in ("date", "other") or kind == "number" and math.isnan(value):
        return _false()
    return c.eqNullSafe(F.lit(value))


_TESTS = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _ordered(c: Column, op: str, value: Any, floating: bool) -> Column:
    """Same-type order; NaN in the rows cannot be compared and passes (Spark puts it above all numbers)."""
    test = _TESTS[op](c, F.lit(value))
    return test | (c == F.lit(_NAN)) if floating and op in ("$lt", "$lte") else test


def compares(v: Value | None, op: str, value: Any) -> Column:
    if v is None:
        return _false()
    kind, there = kind_of(value), ~v.empty
    if len(v.by_kind) == 1 and not v.open_kinds:
        own, c = next(iter(v.by_kind.items()))
        there = c.isNotNull()
        if own == kind and kind in ("number", "string", "boolean", "date") and not (kind == "number" and math.isnan(value)):
            return there & _ordered(c, op, value, v.floating)
    target, parts = _number(value), []
    for own, c in v.by_kind.items():
        if own == kind == "string":
            parts.append((c.isNotNull(), _TESTS[op](c, F.lit(value))))
            continue
        if math.isnan(target):
            continue
        x = number_of_text(c) if own == "string" else js_number(c, {"number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType()}[own], None)
        parts.append((c.isNotNull(), F.coalesce(_TESTS[op](x, F.lit(target)), _true())))
    passes = reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), parts, _true())
    return there & passes


def member(v: Value | None, values: Any) -> Column:
    """In a list, by strict equality, except that NaN is in a list with NaN."""
    if not isinstance(values, (list, tuple)):
        return _false()
    tests = []
    for kind in ("number", "string", "boolean"):
        own = [x for x in values if kind_of(x) == kind]
        c = v.of(kind) if v is not None else None
        if own and c is not None:
            tests.append(c.isNotNull() & c.isin(own))
    if any(x is None for x in values) and v is not None:
        tests.append(_explicit_null(v))
    if any(x is MISSING for x in values):
        tests.append(_true() if v is None else ~v.exists)
    return reduce(lambda a, b: a | b, tests) if tests else _false()


def _pattern(p: Any) -> str:
    """A regular expression: a string ignores case, a compiled one keeps its own flags."""
    if isinstance(p, re.Pattern):
        flags = "".join(x for f, x in ((re.I, "i"), (re.M, "m"), (re.S, "s")) if p.flags & f)
        return f"(?{flags}u){p.pattern}" if flags else p.pattern
    return f"(?iu){p}"


def _text(v: Value | None, test) -> Column:
    c = v.of("string") if v is not None else None
    return _false() if c is None else c.isNotNull() & test(c)


def condition(v: Value | None, test: Any) -> Column:
    """One field's condition: a literal, a compiled regular expression, or a dictionary of operators that must all hold."""
    if isinstance(test, re.Pattern):
        return _text(v, lambda c: c.rlike(_pattern(test)))
    if kind_of(test) == "date" or isinstance(test, (list, tuple)):
        return _true()  # not a literal that can be compared: no condition
    if not isinstance(test, dict):
        return equals(v, test)
    parts = []
    for op, x in test.items():
        if op == "$eq":
            parts.append(equals(v, x))
        elif op == "$ne":
            parts.append(~equals(v, x))
        elif op == "$exists":
            exists = _false() if v is None else v.exists
            parts.append(exists if x else ~exists)
        elif op in _TESTS:
            parts.append(compares(v, op, x))
        elif op == "$in":
            parts.append(member(v, x))
        elif op == "$nin" and isinstance(x, (list, tuple)):
            parts.append(~member(v, x))
        elif op == "$between":
            parts.append(compares(v, "$gte", x[0]) & compares(v, "$lte", x[1]))
        elif op == "$startsWith":
            parts.append(_text(v, lambda c, x=x: c.startswith(x)))
        elif op == "$endsWith":
            parts.append(_text(v, lambda c, x=x: c.endswith(x)))
        elif op == "$contains":
            parts.append(_text(v, lambda c, x=x: c.contains(x)))
        elif op == "$regex":
            parts.append(_text(v, lambda c, x=x: c.rlike(_pattern(x))))
    return reduce(lambda a, b: a & b, parts) if parts else _true()


def matches(fields, where: dict[str, Any]) -> Column:
    """All conditions of ``where``; an empty one matches every row."""
    tests = [condition(fields.value(name), test) for name, test in where.items()]
    return reduce(lambda a, b: a & b, tests) if tests else _true()


@dataclass(frozen=True)
class Clauses:
    """``where`` and every one of ``and_`` make the base. Each of ``or_`` and each group of ``or_groups`` (all of the group) is an alternative, united with the base. ``not_`` takes away."""

    where: dict[str, Any] | None = None
    and_: tuple[dict[str, Any], ...] = ()
    or_: tuple[dict[str, Any], ...] = ()
    or_groups: tuple[tuple[dict[str, Any], ...], ...] = field(default=())
    not_: dict[str, Any] | None = None

    def column(self, fields) -> Column:
        base = [matches(fields, w) for w in ((self.where,) if self.where is not None else ()) + tuple(self.and_)]
        united = [matches(fields, w) for w in self.or_]
        united += [reduce(lambda a, b: a & b, (matches(fields, w) for w in g), _true()) for g in self.or_groups]
        if base:
            united.insert(0, reduce(lambda a, b: a & b, base))
        result = reduce(lambda a, b: a | b, united) if united else _true()
        return result & ~matches(fields, self.not_) if self.not_ is not None else result
