"""Grouped metrics with the numeric rules of dynamically typed records, filters on groups, and totals."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.coerce import js_number, number_of_text, rounded4
from tessera.operators.predicates import DocumentFields, TypedFields, matches


@dataclass(frozen=True)
class Metric:
    """``op``: count, sum, avg, min, max or stddev; without a field every row counts as 1."""

    name: str
    op: str
    field: str | None = None


@dataclass(frozen=True)
class Aggregate:
    metrics: tuple[Metric, ...]
    group_by: tuple[str, ...] = ()
    where: dict[str, Any] | None = None
    having: dict[str, Any] | None = None
    limit: int | None = None


class Aggregated(NamedTuple):
    """``groups``: keys, metrics and record_count of each; ``totals``: one row, whose record_count is the number of rows evaluated."""

    groups: DataFrame
    totals: DataFrame


def _metric(m: Metric, schema: T.StructType) -> Column:
    rows = F.count(F.lit(1))
    if m.op == "count":
        return rows
    if m.field is None:
        x = F.lit(1.0)
    elif m.field in schema.fieldNames():
        x = js_number(F.col(f"`{m.field}`"), schema[m.field].dataType)
    else:
        x = F.lit(None).cast("double")
    if m.op == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if m.op == "avg":  # over all rows of the group, those without a number too
        return rounded4(F.coalesce(F.sum(x), F.lit(0.0)) / rows)
    if m.op in ("min", "max"):
        return F.coalesce((F.min if m.op == "min" else F.max)(x), F.lit(0.0))
    if m.op == "stddev":
        return rounded4(F.coalesce(F.stddev_pop(x), F.lit(0.0)))
    raise ValueError(f"unknown metric {m.op!r}")


_HAVING = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b}


def _having(spec: dict[str, Any], names: set[str]) -> Column:
    tests = []
    for name, test in spec.items():
        count = name in ("count", "_count")
        c = F.col("record_count") if count else F.col(f"`{name}`") if name in names else None
        for op, x in (test if isinstance(test, dict) else {"$eq": test}).items():
            if op in _HAVING:
                tests.append(_HAVING[op](c, F.lit(x)) if c is not None else F.lit(op == "$ne"))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def aggregate(df: DataFrame, spec: Aggregate, *, order: str | None = None) -> Aggregated:
    """(groups, totals): keys, metrics and ``record_count`` of each group, and the metrics of all rows before ``having`` and ``limit``.

    No rows give no groups, grouped or not. NaN in a key counts as null. With ``limit``, groups are the first by ``order``.
    """
    rows = df.where(matches(TypedFields(df.schema), spec.where)) if spec.where else df
    schema = df.schema
    metrics = [_metric(m, schema).alias(m.name) for m in spec.metrics] + [F.count(F.lit(1)).alias("record_count")]
    keys = []
    for k in spec.group_by:
        c = F.col(f"`{k}`") if k in schema.fieldNames() else F.lit(None).cast("string")
        floating = k in schema.fieldNames() and isinstance(schema[k].dataType, (T.FloatType, T.DoubleType))
        keys.append((F.when(c != F.lit(float("nan")), c) if floating else c).alias(k))
    totals = rows.agg(*metrics)
    limit = spec.limit if spec.limit and spec.limit > 0 and order else None
    first = [F.min(order).alias("__first")] if limit else []
    groups = rows.groupBy(*keys).agg(*metrics, *first) if keys else rows.agg(*metrics, *first).where("record_count > 0")
    if spec.having:
        groups = groups.where(_having(spec.having, {m.name for m in spec.metrics}))
    if limit:
        groups = groups.orderBy("__first").limit(limit).drop("__first")
    elif spec.limit and spec.limit > 0:
        groups = groups.limit(spec.limit)
    return Aggregated(groups, totals)


def aggregate_documents(df: DataFrame, document: str, spec: Aggregate, *, order: str | None = None) -> Aggregated:
    """``aggregate`` of records in a VARIANT column. Keys come as JSON text (``1`` and ``"1"`` are two groups; null without the field, ``null`` where it is null).

    A field that a record lacks adds nothing to a metric, an explicit null counts as 0.
    """
    fields = DocumentFields(document)
    rows = df.where(matches(fields, spec.where)) if spec.where else df

    def number(name: str) -> Column:
        v = fields.value(name)
        c = v.by_kind
        known = F.coalesce(c["number"], number_of_text(c["string"]), c["boolean"].cast("int").cast("double"))
        return F.when(v.exists & v.empty, F.lit(0.0)).otherwise(F.coalesce(known, F.lit(float("nan"))))

    keys = [F.to_json(fields.raw(k)).alias(k) for k in spec.group_by]
    numbers = {f"__{i}": number(m.field) for i, m in enumerate(spec.metrics) if m.field is not None}
    flat = rows.select(*keys, *(c.alias(n) for n, c in numbers.items()), *([F.col(order).alias("__order")] if order else []))
    metrics = tuple(replace(m, field=f"__{i}") if m.field is not None else m for i, m in enumerate(spec.metrics))
    return aggregate(flat, replace(spec, metrics=metrics, where=None), order="__order" if order else None)
