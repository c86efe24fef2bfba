import math

import pytest

from tessera.operators.aggregate import Aggregate, Metric
from tessera.operators.predicates import Clauses
from tessera.operators.query import Options, Table

ROWS = [(1, "a", 3.0, "12"), (2, "b", None, "abc"), (3, "a", float("nan"), None), (4, None, -1.0, ""), (5, "b", 2.5, "0x1f"), (6, "a", 3.0, " 1e2 ")]


@pytest.fixture
def table(frame):
    return Table(frame(ROWS, "id long, k string, v double, t string"), "id", "id")


def ids(df):
    return [r.id for r in df.collect()]


def test_nulls_sort_last_either_way_and_ties_keep_their_order(table):
    assert ids(table.query(Options(sort=(("k", "desc"),)))) == [2, 5, 1, 3, 6, 4]
    assert ids(table.query(Options(sort=(("k", "asc"), ("v", "desc"))))) == [3, 1, 6, 5, 2, 4]  # NaN is above numbers
    assert ids(table.query(Options(sort=(("nowhere", "asc"),)))) == [1, 2, 3, 4, 5, 6]


def test_pages(table):
    assert ids(table.query(Options(limit=2, offset=3))) == [4, 5]
    assert ids(table.query(Options(limit=0))) == []
    for bad in (-1, 1.5, True, 2**60):
        with pytest.raises(ValueError):
            table.query(Options(limit=bad))


def test_builder_is_immutable_and_branches_unite(table):
    base = table.select().where("k").equals("a")
    wider = base.or_(lambda b: b.where("v").less_than(0))
    assert ids(base.execute()) == [1, 3, 6] and ids(wider.order_by("id").execute()) == [1, 3, 4, 6]
    assert wider.limit(1).count() == 4 and ids(base.offset(1).first()) == [3]
    plan = base.explain()
    assert "Filter" in plan.text and (plan.candidates, plan.matched) == (6, 3)


def test_changes_give_new_tables(table, frame):
    new = table.put_many(frame([(2, "z", 1.0, None), (9, "n", None, None)], "id long, k string, v double, t string"))
    assert sorted(ids(new.df)) == [1, 2, 3, 4, 5, 6, 9] and new.get(2).first().k == "z" and table.get(2).first().k == "b"
    assert sorted(ids(new.delete_where({"k": "a"}).df)) == [2, 4, 5, 9]
    ok, swapped, _ = table.swap_if(1, {"k": "a"}, {"k": "q"})
    assert ok and swapped.get(1).first().k == "q"
    assert table.swap_if(77, {}, {"k": "q"})[0] is False and table.swap_if(1, {"k": "b"}, {"k": "q"})[0] is False
    with pytest.raises(ValueError):
        table.update_where({}, {"id": 3})


def test_metrics(table):
    spec = Aggregate(tuple(Metric(op, op, "v") for op in ("sum", "avg", "min", "max", "stddev")) + (Metric("n", "count", "v"), Metric("ones", "sum"), Metric("texts", "sum", "t"), Metric("none", "max", "nowhere")), ("k",))
    groups, totals = table.aggregate(spec)
    got = {r.k: r.asDict() for r in groups.collect()}
    a, b = got["a"], got["b"]
    assert (a["sum"], a["avg"], a["n"], a["ones"], a["stddev"], a["texts"]) == (6.0, 2.0, 3, 3.0, 0.0, 112.0)
    # null counts as 0; the mean is over all rows of the group
    assert (b["sum"], b["avg"], b["min"], b["max"], b["texts"], b["none"]) == (2.5, 1.25, 0.0, 2.5, 31.0, 0.0)
    assert b["stddev"] == 1.25 and got[None]["sum"] == -1.0
    assert totals.first().record_count == 6


def test_groups_having_limit_and_empty(table, frame):
    spec = Aggregate((Metric("n", "count"), Metric("s", "sum", "v")), ("k",), having={"count": {"$gte": 2}, "s": {"$gt": 2.5}})
    assert [r.k for r in table.aggregate(spec)[0].collect()] == ["a"]
    assert table.aggregate(Aggregate((Metric("n", "count"),), ("k",), having={"zzz": {"$gt": 1}}))[0].count() == 0
    assert table.aggregate(Aggregate((Metric("n", "count"),), ("k",), having={"zzz": {"$ne": 1}}))[0].count() == 3
    assert [r.k for r in table.aggregate(Aggregate((Metric("n", "count"),), ("k",), limit=2))[0].collect()] == ["a", "b"]
    assert table.aggregate(Aggregate((Metric("n", "count"),), where={"k": "zzz"}))[0].count() == 0
    nan = Table(frame([(1, float("nan")), (2, None)], "id long, v double"), "id")
    assert nan.aggregate(Aggregate((Metric("n", "count"),), ("v",)))[0].count() == 1


def test_half_rounds_up(frame):
    t = Table(frame([(1, -0.00005), (2, 0.0)], "id long, v double"), "id")
    assert t.aggregate(Aggregate((Metric("m", "sum", "v"), Metric("a", "avg", "v"))))[0].first().a in (0.0, -0.0)
    big = Table(frame([(1, 1e300), (2, math.inf)], "id long, v double"), "id")
    assert big.aggregate(Aggregate((Metric("a", "avg", "v"),)))[0].first().a == math.inf


def test_documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, '{"a": 2}'), (2, '{"a": "x"}'), (3, "{}"), (4, '{"a": 1}')], "id long, d string").select("id", F.parse_json("d").alias("doc"))
    t = Table(df, "id", "id", document="doc")
    assert ids(t.query(Options(Clauses({"a": {"$exists": True}}), sort=(("a", "asc"),)))) == [4, 1, 2]


def test_documents_tell_absent_from_null(spark):
    from pyspark.sql import functions as F

    texts = ['{"g": 1, "x": 2}', '{"g": 1, "x": null}', '{"g": "1"}', '{"x": "abc"}', '{"g": null, "x": "0x10"}', '{"g": 1, "x": true}']
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.parse_json("t").alias("doc"))
    spec = Aggregate((Metric("n", "count"), Metric("total", "sum", "x"), Metric("low", "min", "x")), ("g",))
    groups, totals = Table(docs, "i", "i", document="doc").aggregate(spec)
    assert {r.g: (r.n, r.total, r.low) for r in groups.collect()} == {"1": (3, 3.0, 0.0), '"1"': (1, 0.0, 0.0), None: (1, 0.0, 0.0), "null": (1, 16.0, 16.0)}
    assert [(r.n, r.total) for r in totals.collect()] == [(6, 19.0)]
