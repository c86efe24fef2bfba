"""Filters against a row-by-row model of their rules, on rows with nulls, NaN, infinities and strings."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators.predicates import MISSING, Clauses, DocumentFields, TypedFields, _number, condition, kind_of

NAN = float("nan")
ROWS = [(1, 5.0, "abc", True, 3), (2, None, None, None, None), (3, NAN, "", False, 0), (4, -2.5, "12", True, -7), (5, math.inf, " 7 ", False, 9), (6, 0.0, "0x10", None, 2), (7, 12.0, "Zed.é", True, 12), (8, -math.inf, "\n", False, 1), (9, 5.0, "abcABC", None, 5)]
SCHEMA = "id int, x double, s string, b boolean, n int"
NAMES = ["id", "x", "s", "b", "n"]


def number(v):
    return NAN if v is MISSING else _number(v)


def below(a, b):
    """a < b with the rules of coercion; False where they cannot be compared."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    return number(a) < number(b)


def at_most(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return a <= b
    return number(a) <= number(b)


def same(a, b):
    return kind_of(a) == kind_of(b) and a == b and not (isinstance(a, float) and math.isnan(a))


def model(a, test):
    if isinstance(test, re.Pattern):
        return isinstance(a, str) and bool(test.search(a))
    if isinstance(test, (list, tuple, dt.datetime)):
        return True
    if not isinstance(test, dict):
        return a is MISSING if test is MISSING else a is not MISSING and same(a, test)
    there = a is not None and a is not MISSING
    inside = lambda vs: any(same(a, v) or (isinstance(a, float) and isinstance(v, float) and math.isnan(a) and math.isnan(v)) for v in vs if v is not MISSING and a is not MISSING)
    rules = {
        "$eq": lambda v: a is not MISSING and same(a, v),
        "$ne": lambda v: not (a is not MISSING and same(a, v)),
        "$exists": lambda v: (a is not MISSING) == v,
        "$gt": lambda v: there and not at_most(a, v),
        "$gte": lambda v: there and not below(a, v),
        "$lt": lambda v: there and not at_most(v, a),
        "$lte": lambda v: there and not below(v, a),
        "$in": lambda v: isinstance(v, (list, tuple)) and inside(v),
        "$nin": lambda v: not isinstance(v, (list, tuple)) or not inside(v),
        "$between": lambda v: there and not below(a, v[0]) and not below(v[1], a),
        "$startsWith": lambda v: isinstance(a, str) and a.startswith(v),
        "$endsWith": lambda v: isinstance(a, str) and a.endswith(v),
        "$contains": lambda v: isinstance(a, str) and v in a,
        "$regex": lambda v: isinstance(a, str) and bool(re.search(v, a, re.I) if isinstance(v, str) else v.search(a)),
    }
    return all(rules[k](v) for k, v in test.items() if k in rules)


TESTS = [
    5.0, 5, None, NAN, "abc", True, False, re.compile("abc"), [1], {}, dt.datetime(2024, 1, 1), MISSING,
    {"$eq": 5}, {"$eq": None}, {"$ne": 5}, {"$ne": None}, {"$exists": True}, {"$exists": False},
    *({op: v} for op in ("$gt", "$gte", "$lt", "$lte") for v in (5, 0, -2.5, "abc", "12", NAN, True, math.inf)),
    {"$between": [0, 6]}, {"$between": ["a", "b"]}, {"$gt": 0, "$lt": 10}, {"$in": [5, None, "abc", True]}, {"$in": []}, {"$in": "abc"}, {"$in": [NAN]},
    {"$nin": [5, "abc"]}, {"$nin": []}, {"$nin": [None]}, {"$nin": 3}, {"$startsWith": "ab"}, {"$endsWith": "C"}, {"$contains": "b"}, {"$regex": "É$"}, {"$regex": re.compile("^A")}, {"$other": 1},
]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize("name", ["x", "s", "b", "n", "nowhere"])
def test_typed_conditions_follow_the_model(typed, name):
    fields = TypedFields(typed.schema)
    columns = [condition(fields.value(name), t) for t in TESTS]
    got = typed.select("id", *(c.alias(f"p{i}") for i, c in enumerate(columns)), *((~c).alias(f"n{i}") for i, c in enumerate(columns))).collect()
    for row, raw in zip(sorted(got), ROWS, strict=True):
        value = dict(zip(NAMES, raw, strict=True)).get(name, MISSING)
        for i, t in enumerate(TESTS):
            want = model(value, t)
            assert row[f"p{i}"] is want and row[f"n{i}"] is (not want), (name, value, t)


DOCS = ['{"f": 5}', '{"f": 5.5}', '{"f": "abc"}', '{"f": "12"}', '{"f": null}', "{}", '{"f": true}', '{"f": [1]}', '{"f": {"a": 1}}', '{"f": -1e3}', '{"f": ""}']


def test_document_conditions_follow_the_model(spark):
    import json

    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "id int, d string").select("id", F.parse_json("d").alias("doc"))
    value = DocumentFields("doc").value("f")
    tests = [t for t in TESTS if not (isinstance(t, float) and math.isnan(t))]
    columns = [condition(value, t) for t in tests]
    got = df.select("id", *(c.alias(f"p{i}") for i, c in enumerate(columns)), *((~c).alias(f"n{i}") for i, c in enumerate(columns))).collect()
    for row, raw in zip(sorted(got), DOCS, strict=True):
        a = json.loads(raw).get("f", MISSING)
        for i, t in enumerate(tests):
            want = model(a, t)
            assert row[f"p{i}"] is want and row[f"n{i}"] is (not want), (a, t)


def test_clauses(typed):
    fields = TypedFields(typed.schema)
    ids = lambda c: sorted(r.id for r in typed.where(c.column(fields)).collect())
    assert ids(Clauses()) == list(range(1, 10))
    assert ids(Clauses({"n": {"$gt": 4}}, and_=({"b": True},))) == [7]
    assert ids(Clauses({"n": 3}, or_=({"n": 9}, {"n": 12}))) == [1, 5, 7]
    assert ids(Clauses(or_=({"n": 9},))) == [5]
    assert ids(Clauses(or_groups=(({"n": {"$gt": 4}}, {"x": 5.0}), ({"id": 2},)))) == [2, 9]
    assert ids(Clauses(or_groups=((),))) == list(range(1, 10))
    assert ids(Clauses({"id": {"$lt": 5}}, not_={"b": True})) == [2, 3]


def test_same_type_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda w: df.where(Clauses(w).column(TypedFields(df.schema)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,3)" in plan({"n": {"$gt": 3}})
    assert "StringStartsWith(s,ab)" in plan({"s": {"$startsWith": "ab"}})
    assert "EqualNullSafe(n,3)" in plan({"n": {"$ne": 3}})
