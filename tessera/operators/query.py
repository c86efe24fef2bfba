"""Tables as lazy DataFrames: filter, sort, page, and a fluent builder over immutable options."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ConstraintError
from tessera.operators.aggregate import Aggregate, Aggregated, aggregate, aggregate_documents
from tessera.operators.constraints import Schema, checked, filled
from tessera.operators.predicates import Clauses, DocumentFields, TypedFields, matches

_MOST = 2**53 - 1


def _count(name: str, n: Any) -> int | None:
    if n is None:
        return None
    if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= _MOST:
        raise ValueError(f"{name} must be a whole number from 0: {n!r}")
    return n


@dataclass(frozen=True)
class Options:
    clauses: Clauses = Clauses()
    sort: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None


class Table:
    """A DataFrame with the column of its keys and, if rows have an order of insertion, the column that numbers them.

    ``document``: the VARIANT column that holds the records; without it the columns are the fields. ``schema``: what its rows
    must obey; every change is checked as a whole, on the rows as they end up (with an ``order`` or expiry column declared too).
    """

    def __init__(self, df: DataFrame, key: str, order: str | None = None, document: str | None = None, schema: Schema | None = None, deferred: bool = False):
        self.df, self.key, self.order, self.document, self.schema, self.deferred = df, key, order, document, schema, deferred
        self.fields = DocumentFields(document) if document else TypedFields(df.schema)

    @classmethod
    def from_parquet(cls, spark, path: str, key: str, order: str | None = None) -> Table:
        return cls(spark.read.parquet(path), key, order)

    def with_rows(self, df: DataFrame) -> Table:
        return Table(df, self.key, self.order, self.document, self.schema, self.deferred)

    def _changed(self, df: DataFrame) -> Table:
        return self.with_rows(df if self.schema is None or self.deferred else checked(df, self.schema))

    def _sort_column(self, name: str):
        if not self.document:
            return F.col(f"`{name}`")
        v = self.fields.value(name)
        return F.coalesce(v.by_kind["number"].cast("string"), v.by_kind["string"], v.by_kind["boolean"].cast("string"))

    def query(self, options: Options = Options()) -> DataFrame:
        """Rows that match, sorted (nulls last either way, then by insertion), from ``offset``, ``limit`` of them."""
        limit, offset = _count("limit", options.limit), _count("offset", options.offset)
        out = self.df.where(options.clauses.column(self.fields))
        if options.sort:
            known = set(self.df.columns)
            keys = []
            for name, direction in options.sort:
                if self.document or name in known:
                    columns = [self.fields.value(name).by_kind["number"], self._sort_column(name)] if self.document else [self._sort_column(name)]
                    keys += [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last() for c in columns]
            if self.order:
                keys.append(F.col(self.order).asc())
            out = out.orderBy(*keys) if keys else out
        elif self.order and (limit is not None or offset):
            out = out.orderBy(self.order)
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key)).limit(1)

    def entries(self, options: Options = Options()) -> DataFrame:
        """``_key`` and ``record`` of the rows that ``query`` gives."""
        return self.query(options).select(F.col(self.key).alias("_key"), F.struct(*(c for c in self.df.columns if c != self.order)).alias("record"))

    def count(self) -> int:
        return self.df.count()

    def select(self) -> Builder:
        return Builder(self)

    def aggregate(self, spec: Aggregate) -> Aggregated:
        if self.document:
            return aggregate_documents(self.df, self.document, spec, order=self.order)
        return aggregate(self.df, spec, order=self.order)

    # changes: each gives a new table, the old one stays as it is

    def put_many(self, rows: DataFrame) -> Table:
        """Rows inserted, or put in the place of those of the same key. Of several with one key the last in ``order`` counts; without an order, the one with the largest hash."""
        by = F.col(self.order) if self.order and self.order in rows.columns else F.xxhash64(*rows.columns)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")
        last = filled(last, self.schema) if self.schema else last
        return self._changed(self.df.join(rows.select(self.key).distinct(), self.key, "left_anti").unionByName(last, allowMissingColumns=True))

    def insert(self, rows: DataFrame) -> Table:
        """Rows added; ConstraintError if a key is null, there already, or twice among them."""
        keys = rows.select(self.key)
        there = self.df.select(self.key).join(keys.distinct(), self.key, "left_semi").limit(1).collect()
        twice = keys.groupBy(self.key).count().where(f"count > 1 or `{self.key}` is null").limit(1).collect()
        if there or twice:
            raise ConstraintError(f"primary key {self.key}: {(there or twice)[0][0]!r} is there already, repeats or is null")
        return self._changed(self.df.unionByName(filled(rows, self.schema) if self.schema else rows, allowMissingColumns=True))

    def delete_many(self, keys: DataFrame) -> Table:
        return self._changed(self.df.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def clear(self) -> Table:
        return self.with_rows(self.df.limit(0))

    def delete_where(self, where: dict[str, Any]) -> Table:
        return self.with_rows(self.df.where(~matches(self.fields, where)))

    def update_where(self, where: dict[str, Any], changes: dict[str, Any]) -> Table:
        """``changes``: column to a literal or a column expression over the old row."""
        hit = matches(self.fields, where)
        new = {c: F.when(hit, v if hasattr(v, "_jc") or type(v).__name__ == "Column" else F.lit(v)).otherwise(F.col(c)).cast(self.df.schema[c].dataType) for c, v in changes.items()}
        if self.key in new:
            raise ConstraintError("a key cannot be changed")
        return self._changed(self.df.withColumns(new))

    def swap_if(self, key: Any, where: dict[str, Any], changes: dict[str, Any]) -> tuple[bool, Table, DataFrame]:
        """Compare and swap of one row: (whether it was there and matched, the table after, the row as it is then)."""
        one = {self.key: key, **where}
        found = bool(self.df.where(matches(self.fields, one)).limit(1).count())
        after = self.update_where(one, changes) if found else self
        return found, after, after.get(key)

    def transaction(self, change: Callable[[Table], Table]) -> Table:
        """The table after ``change``, a function that makes several changes one after the other and reads what it has made.

        The schema is checked once, on the rows at the end, so rows may break it in between. If the function or that check raises,
        nothing has changed: this table is as it was.
        """
        after = change(Table(self.df, self.key, self.order, self.document, self.schema, True))
        return self._changed(after.df)

    def live(self, now: Any, expires: str = "expires_at") -> Table:
        """The table of the rows that have not expired; a row put without ``expires`` never does."""
        return self.with_rows(self.df.where(F.col(expires).isNull() | (F.col(expires) > F.lit(now))))


_METHODS = {"equals": "$eq", "not_equals": "$ne", "greater_than": "$gt", "greater_or_equal": "$gte", "less_than": "$lt", "less_or_equal": "$lte", "is_in": "$in", "not_in": "$nin", "starts_with": "$startsWith", "contains": "$contains", "matches": "$regex"}


@dataclass(frozen=True)
class Builder:
    """``table.select().where("qty").greater_than(5).order_by("qty", "desc").limit(3).execute()``; every call gives a new builder."""

    table: Table
    tests: tuple[dict[str, Any], ...] = ()
    branches: tuple[tuple[dict[str, Any], ...], ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    limit_: int | None = None
    offset_: int | None = None

    def where(self, name: str) -> Test:
        return Test(self, name)

    and_ = where

    def or_(self, branch) -> Builder:
        """``branch`` gets an empty builder and returns it with the tests of one alternative."""
        made = branch(Builder(self.table))
        return replace(self, branches=(*self.branches, made.tests, *made.branches))

    def order_by(self, name: str, direction: str = "asc") -> Builder:
        return replace(self, sort=(*self.sort, (name, direction)))

    def limit(self, n: int) -> Builder:
        return replace(self, limit_=_count("limit", n))

    def offset(self, n: int) -> Builder:
        return replace(self, offset_=_count("offset", n))

    def options(self) -> Options:
        where, rest = (self.tests[0], self.tests[1:]) if self.tests else (None, ())
        return Options(Clauses(where=where, and_=rest, or_groups=self.branches), self.sort, self.limit_, self.offset_)

    def execute(self) -> DataFrame:
        return self.table.query(self.options())

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def count(self) -> int:
        return self.table.query(replace(self.options(), limit=None, offset=None, sort=())).count()

    def explain(self) -> Plan:
        """How Spark answers the query, and how many rows it is chosen from and matches (two counts)."""
        df = self.execute()
        text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        pushed = tuple(dict.fromkeys(x for line in re.findall(r"PushedFilters: \[(.*)\]", text) for x in re.split(r", (?=[A-Z]\w*\()", line) if x))
        return Plan(text, "pushed filters" if pushed else "full scan", pushed, self.table.count(), df.count())


@dataclass(frozen=True)
class Plan:
    text: str
    strategy: str
    pushed: tuple[str, ...]
    candidates: int
    matched: int


@dataclass(frozen=True)
class Test:
    builder: Builder
    name: str

    def _with(self, test: Any) -> Builder:
        return replace(self.builder, tests=(*self.builder.tests, {self.name: test}))

    def between(self, low: Any, high: Any) -> Builder:
        return self._with({"$between": [low, high]})


for _method, _op in _METHODS.items():
    setattr(Test, _method, lambda self, value, _op=_op: self._with({_op: value}))
