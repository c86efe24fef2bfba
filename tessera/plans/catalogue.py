"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConstraintError
from tessera.functions import coerce, text
from tessera.operators import changelog, constraints
from tessera.operators import threevalued as tv
from tessera.operators.aggregate import Aggregate, Metric
from tessera.operators.predicates import MISSING, Clauses
from tessera.operators.query import Options, Table
from tessera.sources import blobs, snapshots
from tessera.streaming import events

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Customers with an account balance that is null for every seventh.
_CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> Table:
    bal = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return Table(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", bal.alias("bal")), "c_custkey", "c_custkey")


def _filter(name: str, where: dict, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _customers(spark, sf_dir).query(Options(Clauses(where))).select("c_custkey", "bal")

    _QUERIES[name], _SQL[name] = run, f"SELECT c_custkey, bal FROM ({_CUSTOMERS}) WHERE {condition}"


_filter("filter_eq", {"c_mktsegment": "FURNITURE"}, "c_mktsegment = 'FURNITURE'")
_filter("filter_eq_null", {"bal": None}, "bal IS NULL")
_filter("filter_ne", {"bal": {"$ne": 0.0}, "c_mktsegment": {"$ne": "FURNITURE"}}, "bal IS DISTINCT FROM 0 AND c_mktsegment <> 'FURNITURE'")
_filter("filter_gt", {"bal": {"$gt": 5000}}, "bal > 5000")
_filter("filter_gte", {"bal": {"$gte": 5000.5}}, "bal >= 5000.5")
_filter("filter_lt", {"bal": {"$lt": 1000}}, "bal < 1000")
_filter("filter_lte", {"bal": {"$lte": 999.99}}, "bal <= 999.99")
_filter("filter_in", {"c_custkey": {"$in": [1, 5, 7, 14, 99, "x"]}, "bal": {"$in": [None, 2229.54]}}, "c_custkey IN (1, 5, 7, 14, 99) AND (bal IS NULL OR bal = 2229.54)")
_filter("filter_nin", {"c_mktsegment": {"$nin": ["FURNITURE", "BUILDING"]}, "bal": {"$nin": [None]}}, "c_mktsegment NOT IN ('FURNITURE', 'BUILDING') AND bal IS NOT NULL")
_filter("filter_between", {"bal": {"$between": [100, 2000]}}, "bal BETWEEN 100 AND 2000")
_filter("filter_mixed_types", {"c_mktsegment": {"$gt": 5}, "bal": {"$gt": "1000"}}, "bal > 1000")
_filter("filter_absent_field", {"nowhere": {"$ne": 3}, "bal": {"$exists": True}, "other": MISSING}, "TRUE")


def _part_filter(name: str, where: dict, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Table(_read(spark, sf_dir, "part"), "p_partkey").query(Options(Clauses(where))).select("p_partkey", "p_name")

    _QUERIES[name], _SQL[name] = run, f"SELECT p_partkey, p_name FROM part WHERE {condition}"


_part_filter("filter_starts_with", {"p_name": {"$startsWith": "cold"}}, "starts_with(p_name, 'cold')")
_part_filter("filter_ends_with", {"p_name": {"$endsWith": "get"}}, "suffix(p_name, 'get')")
_part_filter("filter_contains", {"p_name": {"$contains": "l w"}}, "contains(p_name, 'l w')")
_part_filter("filter_regex", {"p_name": {"$regex": "^SM.*t$"}}, "regexp_matches(p_name, '^sm.*t$', 'i')")
_part_filter("composite_lookup", {"p_brand": "Brand#13", "p_type": "ECONOMY"}, "p_brand = 'Brand#13' AND p_type = 'ECONOMY'")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def filter_document(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return Table(events, "event_id", document="doc").query(Options(Clauses({"k": {"$gte": 50}, "z": {"$exists": False}}))).select("event_id")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def filter_exists(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return Table(events, "event_id", document="doc").query(Options(Clauses({"k": {"$exists": True}}))).select("event_id")


def _orders(name: str, clauses: Clauses, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Table(_read(spark, sf_dir, "orders"), "o_orderkey").query(Options(clauses)).select("o_orderkey", "o_totalprice")

    _QUERIES[name], _SQL[name] = run, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {condition}"


_orders("bool_and", Clauses({"o_orderstatus": "F"}, and_=({"o_totalprice": {"$gt": 1000}}, {"o_totalprice": {"$lt": 90000}})), "o_orderstatus = 'F' AND o_totalprice > 1000 AND o_totalprice < 90000")
_orders("bool_or_union_base", Clauses({"o_orderstatus": "F"}, or_=({"o_totalprice": {"$gt": 200000}},)), "o_orderstatus = 'F' OR o_totalprice > 200000")
_orders("bool_or_groups", Clauses(or_groups=(({"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 5000}}), ({"o_orderkey": 3},))), "(o_orderstatus = 'O' AND o_totalprice < 5000) OR o_orderkey = 3")
_orders("bool_not", Clauses({"o_totalprice": {"$gt": 1000}}, not_={"o_orderstatus": {"$in": ["F", "O"]}}), "o_totalprice > 1000 AND NOT o_orderstatus IN ('F', 'O')")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 17")
def point_lookup(spark, sf_dir):
    return Table(_read(spark, sf_dir, "orders"), "o_orderkey").get(17).select("o_orderkey")


@query(f"SELECT c_custkey, bal FROM ({_CUSTOMERS}) ORDER BY c_mktsegment DESC NULLS LAST, bal ASC NULLS LAST, c_custkey LIMIT 200")
def sort_multi_nulls_last(spark, sf_dir):
    return _customers(spark, sf_dir).query(Options(sort=(("c_mktsegment", "desc"), ("bal", "asc")), limit=200)).select("c_custkey", "bal")


@query(f"SELECT c_custkey FROM ({_CUSTOMERS}) ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 25")
def page_offset_limit(spark, sf_dir):
    return _customers(spark, sf_dir).query(Options(sort=(("bal", "desc"),), limit=10, offset=25)).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf_dir):
    return Table(_read(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey").query(Options(sort=(("o_totalprice", "desc"),), limit=20)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE (p_size >= 10 AND p_size < 40 AND p_name LIKE 'cold%') OR (p_size = 45 AND p_brand IN ('Brand#13', 'Brand#5')) ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 5")
def builder_query(spark, sf_dir):
    b = Table(_read(spark, sf_dir, "part"), "p_partkey", "p_partkey").select().where("p_size").greater_or_equal(10).and_("p_size").less_than(40).and_("p_name").starts_with("cold")
    b = b.or_(lambda x: x.where("p_size").equals(45).and_("p_brand").is_in(["Brand#13", "Brand#5"]))
    return b.order_by("p_retailprice", "desc").limit(50).offset(5).execute().select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 30 ORDER BY p_retailprice, p_partkey LIMIT 1")
def builder_first(spark, sf_dir):
    return Table(_read(spark, sf_dir, "part"), "p_partkey", "p_partkey").select().where("p_size").greater_than(30).order_by("p_retailprice").first().select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 9")
def builder_count(spark, sf_dir):
    b = Table(_read(spark, sf_dir, "part"), "p_partkey").select().where("p_size").between(5, 9)
    return b.table.query(b.options()).agg(F.count("*").alias("n"))


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: coerce.rounded4(F.col(c).cast("double")) for c in columns})


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_r4("sum(l_quantity)")} AS qty, {_r4("sum(l_extendedprice)")} AS price, {_r4("sum(l_discount) / count(*)")} AS disc, count(*) AS record_count
           FROM lineitem WHERE l_quantity >= 10 GROUP BY ALL""")
def agg_group_multi(spark, sf_dir):
    spec = Aggregate((Metric("n", "count"), Metric("qty", "sum", "l_quantity"), Metric("price", "sum", "l_extendedprice"), Metric("disc", "avg", "l_discount")), ("l_returnflag", "l_linestatus"), {"l_quantity": {"$gte": 10}})
    return _round(Table(_read(spark, sf_dir, "lineitem"), "l_orderkey").aggregate(spec)[0], "qty", "price")


@query("SELECT CAST(count(*) AS DOUBLE) AS rows, min(l_tax) AS low, max(l_extendedprice) AS high, count(*) AS record_count FROM lineitem")
def agg_global(spark, sf_dir):
    return Table(_read(spark, sf_dir, "lineitem"), "l_orderkey").aggregate(Aggregate((Metric("rows", "sum"), Metric("low", "min", "l_tax"), Metric("high", "max", "l_extendedprice"))))[0]


@query(f"SELECT event_type, {_r4('stddev_pop(value)')} AS sd, count(*) AS record_count FROM events GROUP BY ALL")
def agg_stddev_pop(spark, sf_dir):
    return Table(_read(spark, sf_dir, "events"), "event_id").aggregate(Aggregate((Metric("sd", "stddev", "value"),), ("event_type",)))[0]


@query(f"SELECT c_mktsegment, {_r4('sum(coalesce(bal, 0)) / count(*)')} AS mean, coalesce(min(coalesce(bal, 0)), 0) AS low, count(*) AS record_count FROM ({_CUSTOMERS}) GROUP BY ALL")
def agg_avg_null_denominator(spark, sf_dir):
    return _customers(spark, sf_dir).aggregate(Aggregate((Metric("mean", "avg", "bal"), Metric("low", "min", "bal")), ("c_mktsegment",)))[0]


_TEXTS = "CASE event_id % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '0x10' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '1.5e2' ELSE NULL END"
_NUMBERS = "CASE event_id % 6 WHEN 0 THEN 12.0 WHEN 1 THEN 16.0 WHEN 2 THEN 0.0 WHEN 3 THEN NULL WHEN 4 THEN 150.0 ELSE 0.0 END"


@query(f"SELECT event_type, CAST(sum({_NUMBERS}) AS DOUBLE) AS total, CAST(max({_NUMBERS}) AS DOUBLE) AS high, count(*) AS record_count FROM events GROUP BY ALL")
def agg_string_coercion(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_TEXTS).alias("t"))
    return Table(rows, "event_id").aggregate(Aggregate((Metric("total", "sum", "t"), Metric("high", "max", "t")), ("event_type",)))[0]


@query("SELECT user_id, CAST(sum(1) AS DOUBLE) AS n, max(value) AS high, count(*) AS record_count FROM events GROUP BY user_id HAVING count(*) > 3 AND max(value) <> 0")
def agg_having(spark, sf_dir):
    spec = Aggregate((Metric("n", "sum"), Metric("high", "max", "value")), ("user_id",), having={"count": {"$gt": 3}, "high": {"$ne": 0.0}})
    return Table(_read(spark, sf_dir, "events"), "event_id").aggregate(spec)[0]


@query("SELECT user_id, count(*) AS n, count(*) AS record_count FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 7")
def agg_group_limit(spark, sf_dir):
    return Table(_read(spark, sf_dir, "events"), "event_id", "event_id").aggregate(Aggregate((Metric("n", "count"),), ("user_id",), limit=7))[0]


@query(f"SELECT {_r4('sum(value)')} AS total, count(*) AS record_count FROM events WHERE event_type = 'error'")
def agg_grand_totals(spark, sf_dir):
    spec = Aggregate((Metric("total", "sum", "value"),), ("user_id",), {"event_type": "error"}, having={"count": {"$gt": 10**9}})
    return _round(Table(_read(spark, sf_dir, "events"), "event_id").aggregate(spec)[1], "total")


@query("SELECT count(*) AS n, count(*) AS record_count FROM events WHERE FALSE HAVING count(*) > 0")
def agg_empty_input(spark, sf_dir):
    return Table(_read(spark, sf_dir, "events"), "event_id").aggregate(Aggregate((Metric("n", "count"),), where={"event_type": "none such"}))[0]


# three-valued conditions


def _three(name: str, condition, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _customers(spark, sf_dir).df.where(condition()).select("c_custkey", "bal")

    _QUERIES[name], _SQL[name] = run, f"SELECT c_custkey, bal FROM ({_CUSTOMERS}) WHERE {sql}"


_D, _S = T.DoubleType(), T.StringType()
_three("sql_compare_3vl", lambda: ~tv.compare(F.col("bal"), _D, ">", 500.0) | tv.compare(F.col("c_mktsegment"), _S, "=", 5), "NOT (bal > 500)")
_three("sql_is_null", lambda: F.col("bal").isNull() | tv.compare(F.col("bal"), _D, "=", 2229.54), "bal IS NULL OR bal = 2229.54")
_three("sql_in_null", lambda: ~tv.is_in(F.col("bal"), _D, [2229.54, None]) | tv.is_in(F.col("c_custkey"), T.LongType(), [1, 2, "3"]), "c_custkey IN (1, 2)")
_three("sql_not_between_null", lambda: tv.between(F.col("bal"), _D, 100.0, 3000.0, True), "CASE WHEN bal IS NULL THEN NULL ELSE NOT bal BETWEEN 100 AND 3000 END")
_three("sql_like_ascii", lambda: tv.like(F.col("c_name"), "cUSTOMER#%1_"), "translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'customer#%1_'")
_three("sql_bool_precedence", lambda: tv.compare(F.col("bal"), _D, "<", 0.0) | tv.compare(F.col("bal"), _D, ">", 9000.0) & ~tv.compare(F.col("c_mktsegment"), _S, "=", "FURNITURE"), "bal < 0 OR bal > 9000 AND NOT c_mktsegment = 'FURNITURE'")


@query(f"SELECT c_custkey AS id, bal AS balance FROM ({_CUSTOMERS}) ORDER BY bal ASC NULLS FIRST, c_custkey LIMIT 30")
def sql_select_alias_order(spark, sf_dir):
    rows = _customers(spark, sf_dir).df.select(F.col("c_custkey").alias("id"), F.col("bal").alias("balance"))
    return tv.order_by(rows, [("balance", "asc")], last="id", limit=30)


@query("SELECT s_suppkey FROM supplier")
def sql_limit_negative(spark, sf_dir):
    return tv.order_by(_read(spark, sf_dir, "supplier").select("s_suppkey"), [("s_suppkey", "desc")], limit=-1, offset=-5)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def sql_offset_only(spark, sf_dir):
    return tv.order_by(_read(spark, sf_dir, "nation").select("n_nationkey"), [("n_nationkey", "asc")], offset=20)


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_nationkey <> 3")
def sql_params(spark, sf_dir):
    return tv.select(spark, "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > ? AND s_nationkey <> ?", [1000, 3], supplier=_read(spark, sf_dir, "supplier"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def sql_json_equality(spark, sf_dir):
    return _read(spark, sf_dir, "events").where(tv.compare_json(F.col("props"), "=", '{ "k" : 5.0 }')).select("event_id")


# changes and constraints


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 1")
def dml_insert_view(spark, sf_dir):
    new = spark.range(1).select(F.lit(99).alias("n_nationkey"), F.lit("NEW").alias("n_name"), F.lit(1).alias("n_regionkey"))
    return Table(_read(spark, sf_dir, "nation"), "n_nationkey").insert(new).df


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update_view(spark, sf_dir):
    return Table(_read(spark, sf_dir, "nation"), "n_nationkey").update_where({"n_regionkey": 2}, {"n_name": "CHANGED"}).df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT n_regionkey >= 3")
def dml_delete_view(spark, sf_dir):
    return Table(_read(spark, sf_dir, "nation"), "n_nationkey").delete_where({"n_regionkey": {"$gte": 3}}).df


def _nations(spark: SparkSession, sf_dir: str) -> Table:
    """Nations bound to a schema: names are not null and unique."""
    field = constraints.Field
    schema = constraints.Schema((field("n_nationkey", "INTEGER"), field("n_name", "TEXT", False), field("n_regionkey", "INTEGER", False)), "n_nationkey", (("n_name",),))
    return Table(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")), "n_nationkey", schema=schema)


def _refused(change: Callable[[], Table]) -> None:
    try:
        change()
    except ConstraintError:
        return
    raise AssertionError("a change that breaks a constraint was made")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 1")
def dml_insert_conflict(spark, sf_dir):
    """Of three inserts, that of a key that is there and that of a name that is there are refused, and change nothing."""
    table, new = _nations(spark, sf_dir), lambda k, name: spark.createDataFrame([(k, name, 1)], "n_nationkey long, n_name string, n_regionkey long")
    first = table.df.select("n_name").first()[0]
    _refused(lambda: table.insert(new(5, "OTHER")))
    table = table.insert(new(99, "NEW"))
    _refused(lambda: table.insert(new(100, first)))
    return table.df


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '*' ELSE n_name END AS n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def dml_validated_update(spark, sf_dir):
    """Of three updates, those that make names equal or null are refused."""
    table = _nations(spark, sf_dir)
    _refused(lambda: table.update_where({"n_regionkey": 2}, {"n_name": "SAME"}))
    _refused(lambda: table.update_where({"n_nationkey": 3}, {"n_name": F.lit(None)}))
    return table.update_where({"n_regionkey": 2}, {"n_name": F.concat("n_name", F.lit("*"))}).df


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey WHEN 3 THEN (SELECT n_name FROM nation WHERE n_nationkey = 4) WHEN 4 THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE n_name END AS n_name,
          n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 1""")
def change_set(spark, sf_dir):
    """Two names change places, which breaks their uniqueness in between, and rows go, all at once; another set that ends broken changes nothing."""
    table = _nations(spark, sf_dir)
    a, b = (table.get(k).first()["n_name"] for k in (3, 4))
    swap = lambda t: t.update_where({"n_nationkey": 3}, {"n_name": b}).update_where({"n_nationkey": 4}, {"n_name": a})
    _refused(lambda: table.transaction(lambda t: swap(t).update_where({"n_nationkey": 4}, {"n_name": b})))
    return table.transaction(lambda t: swap(t).delete_where({"n_regionkey": 1})).df


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return constraints.duplicates(_read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'none' AS note FROM nation")
def default_fill(spark, sf_dir):
    schema = constraints.Schema((constraints.Field("n_nationkey", "INTEGER"), constraints.Field("n_name", "TEXT", False), constraints.Field("note", "TEXT", default="none")), "n_nationkey", (("n_name",),))
    return constraints.checked(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), schema)


# text


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9))) AS digest FROM pages""")
def text_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(text.normalise(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_NORMAL = r"trim(CASE WHEN role = 'system' THEN regexp_replace(text, '[ \t]+', ' ', 'g') ELSE regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') END, ' ' || chr(10) || chr(9))"


@query(f"""WITH s AS (SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS a, CAST(sum(ceil(length({_NORMAL}) / 4.0)) AS BIGINT) AS b FROM conversations GROUP BY conv_id)
           SELECT conv_id, a AS tokens_before, b AS tokens_after, greatest(a - b, 0) AS tokens_saved, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE floor(greatest(a - b, 0)::DOUBLE / a * 100 * 100 + 0.5) / 100 END AS percent_saved FROM s""")
def conversation_compaction(spark, sf_dir):
    return text.compact(_read(spark, sf_dir, "conversations"))


@query("""WITH m AS (SELECT conv_id, turn, '{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || '}' AS m FROM conversations),
               h AS (SELECT conv_id, sha256('{"systemPrompt":null,"messages":[' || string_agg(m, ',' ORDER BY turn) || ']}') AS prompt_sha256 FROM m GROUP BY conv_id)
          SELECT conv_id, prompt_sha256, conv_id > min(conv_id) OVER (PARTITION BY prompt_sha256) AS cached FROM h""")
def prompt_hash(spark, sf_dir):
    return text.cached_prompts(text.prompt_hash(_read(spark, sf_dir, "conversations")))


# change log: events as frames


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "DELETE").when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), "CLEAR").otherwise("UPDATE")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("event_id").alias("ts"), op.alias("op"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"))


_FRAMES = """SELECT event_id AS frame_id, CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'CLEAR' ELSE 'UPDATE' END AS op,
                    't' || (user_id % 3) AS "table", CAST(user_id AS VARCHAR) AS "key", props AS payload FROM events"""


@query(f"""WITH f AS ({_FRAMES}), c AS (SELECT "table", max(frame_id) AS cl FROM f WHERE op = 'CLEAR' GROUP BY 1),
                l AS (SELECT f.* FROM f LEFT JOIN c USING ("table") WHERE op <> 'CLEAR' AND (cl IS NULL OR frame_id > cl)),
                r AS (SELECT *, row_number() OVER (PARTITION BY "table", "key" ORDER BY frame_id DESC) AS k, max(CASE WHEN op = 'DELETE' THEN frame_id END) OVER (PARTITION BY "table", "key") AS gone FROM l),
                b AS (SELECT "table", "key", min(frame_id) AS inserted FROM r WHERE gone IS NULL OR frame_id > gone GROUP BY ALL)
           SELECT r."table", r."key", payload, frame_id, inserted FROM r JOIN b USING ("table", "key") WHERE k = 1 AND op <> 'DELETE'""")
def log_replay_current(spark, sf_dir):
    return changelog.replay(_frames(spark, sf_dir))


_TYPED = """CASE event_id % 3 WHEN 0 THEN '{"k":' || event_id % 2 || '}' WHEN 1 THEN '{"k":"' || event_id % 2 || '"}' ELSE '{"k":' || event_id % 2 || '.0,"z":null}' END"""


@query(f"""WITH f AS ({_FRAMES}), g AS (SELECT * REPLACE (CASE WHEN op = 'DELETE' THEN NULL ELSE {_TYPED.replace("event_id", "frame_id")} END AS payload) FROM f),
                c AS (SELECT *, max(CASE WHEN op = 'CLEAR' THEN frame_id END) OVER (PARTITION BY "table" ORDER BY frame_id) AS cl FROM g),
                w AS (SELECT *, lag(payload) OVER p AS prev, lag(op) OVER p AS prev_op, lag(frame_id) OVER p AS prev_id FROM c WHERE op <> 'CLEAR' WINDOW p AS (PARTITION BY "table", "key" ORDER BY frame_id)),
                v AS (SELECT frame_id, replace(CAST(json_extract(prev, '$.k') AS VARCHAR), '.0', '') AS k_old, replace(CAST(json_extract(payload, '$.k') AS VARCHAR), '.0', '') AS k_new,
                             CASE WHEN json_exists(prev, '$.z') THEN 'null' END AS z_old, CASE WHEN json_exists(payload, '$.z') THEN 'null' END AS z_new
                      FROM w WHERE op <> 'DELETE' AND prev_op <> 'DELETE' AND prev_id > coalesce(cl, -1))
           SELECT frame_id, CASE WHEN k_old <> k_new THEN k_old END AS k_old, CASE WHEN k_old <> k_new THEN k_new END AS k_new, z_old IS DISTINCT FROM z_new AS z_changed
           FROM v WHERE k_old <> k_new OR z_old IS DISTINCT FROM z_new""")
def change_diff(spark, sf_dir):
    """Numbers that become strings, fields that come and go as nulls, deletes and CLEARs between."""
    payload = F.when(F.col("op") != "DELETE", F.expr(_TYPED.replace("event_id", "frame_id")))
    diff = changelog.differences(_frames(spark, sf_dir).withColumn("payload", payload), span=1000)
    return diff.select("frame_id", F.col("diff")["k"]["old"].alias("k_old"), F.col("diff")["k"]["new"].alias("k_new"), F.col("diff").getItem("z").isNotNull().alias("z_changed"))


@query(f"""SELECT frame_id, op, payload FROM ({_FRAMES}) UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 1000 = 5""")
def log_torn_tail(spark, sf_dir):
    """Files whose last line was cut off after its first byte, and lines in their middle that are no frames: only the cut ones go."""
    head = F.to_json(F.struct("frame_id", "ts", "op", "table", "key"))
    line = F.concat(F.substring(head, 2, 1 << 30).substr(F.lit(1), F.length(head) - 2), F.lit(',"payload":'), "payload", F.lit(',"checksum":"x"}'), F.when(F.col("frame_id") % 1000 == 5, "\nno frame").otherwise(""))
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    folder = f"{snapshots.shared_folder(spark)}/torn-{uuid.uuid4().hex}"
    _frames(spark, sf_dir).select(F.when(nth == 0, F.concat(F.lit("{"), line)).otherwise(line)).write.option("lineSep", "\n{").text(folder)
    return changelog.torn_tail(changelog.read_frames(spark, folder)).select("frame_id", "op", "payload")


_EXPIRY = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id + user_id END"


@query(f"SELECT event_id FROM events WHERE {_EXPIRY} IS NULL OR {_EXPIRY} > 100")
def ttl_live_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.expr(_EXPIRY).alias("expires_at"))
    return changelog.live_rows(rows, F.lit(100)).select("event_id")


_TAMPERED = """SELECT frame_id, ts, CASE WHEN frame_id = 18 THEN 'DROP' ELSE op END AS op, "table", "key", CASE WHEN frame_id = 5 THEN '{"x":1}' WHEN frame_id = 7 THEN '[]' ELSE payload END AS payload,
                      CASE WHEN frame_id = 15 THEN NULL ELSE checksum END AS checksum, CASE WHEN frame_id = 9 THEN repeat('0', 64) WHEN frame_id IN (1, 21) THEN NULL ELSE previous END AS previous
               FROM @chain WHERE frame_id <> 11 UNION ALL SELECT * FROM @chain WHERE frame_id = 13"""
_HASHED = """frame_id || ':' || ts || ':' || op || ':' || "table" || ':' || "key" || ':' || payload || ':' || """


@query(f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS frame_id, CAST(n_regionkey AS BIGINT) AS ts, 'INSERT' AS op, 'nation' AS "table", n_name AS "key", '{{"r":' || n_regionkey || '}}' AS payload FROM nation),
                chain AS (SELECT n.*, sha256({_HASHED} repeat('0', 64)) AS checksum, repeat('0', 64) AS previous FROM n WHERE frame_id = 1
                          UNION ALL SELECT n.*, sha256({_HASHED.replace("frame_id ||", "n.frame_id ||").replace("ts ||", "n.ts ||").replace(" op ||", " n.op ||").replace('"table"', 'n."table"').replace('"key"', 'n."key"').replace("payload", "n.payload")} c.checksum), c.checksum FROM n JOIN chain c ON n.frame_id = c.frame_id + 1),
                f AS ({_TAMPERED.replace("@", "")}), good AS (SELECT * FROM f WHERE checksum IS NOT NULL AND payload LIKE '{{%'),
                k AS (SELECT frame_id, count(*) AS n, min(checksum) AS own FROM good GROUP BY 1),
                j AS (SELECT g.*, k.n, b.own AS before, coalesce(b.own, repeat('0', 64)) AS expected FROM good g JOIN k USING (frame_id) LEFT JOIN k b ON b.frame_id = g.frame_id - 1),
                w AS (SELECT frame_id, CASE WHEN op = 'DROP' THEN 'op' WHEN n > 1 THEN 'twice' WHEN frame_id > 1 AND before IS NULL THEN 'gap' WHEN previous <> expected THEN 'link'
                                            WHEN checksum <> sha256({_HASHED} expected) THEN 'checksum' END AS why FROM j)
           SELECT frame_id, why FROM w WHERE why IS NOT NULL UNION ALL SELECT frame_id, 'form' FROM f WHERE checksum IS NULL OR payload NOT LIKE '{{%'""")
def chain_verify(spark, sf_dir):
    """A true chain of the nations' frames, of which known ones were changed, lost, doubled or damaged: each with its reason."""
    n = _read(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")).alias("k"), F.col("n_name").alias("key"))
    listed = n.agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("a"))  # 25 rows at every size
    text = lambda i, x: F.concat_ws(":", (i + 1).cast("string"), x["k"][1].cast("string"), F.lit("INSERT"), F.lit("nation"), x["key"], F.concat(F.lit('{"r":'), x["k"][1].cast("string"), F.lit("}")))
    texts = F.transform("a", lambda x, i: text(i, x))
    sums = F.aggregate(texts, F.array(F.lit(changelog.GENESIS)), lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(t, F.lit(":"), F.element_at(acc, -1)), 256))))
    rows = listed.select(F.posexplode("a").alias("i", "x"), sums.alias("c"))
    i = F.col("i")
    chain = rows.select((i + 1).cast("long").alias("frame_id"), F.col("x.k")[1].alias("ts"), F.lit("INSERT").alias("op"), F.lit("nation").alias("table"), F.col("x.key").alias("key"), F.concat(F.lit('{"r":'), F.col("x.k")[1].cast("string"), F.lit("}")).alias("payload"), F.col("c")[i + 1].alias("checksum"), F.col("c")[i].alias("previous"))
    return changelog.violations(tv.select(spark, _TAMPERED.replace("@chain", "{chain}").replace('"table"', "`table`").replace('"key"', "`key`"), chain=chain))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def rollback_state(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    folder = snapshots.shared_folder(spark)
    saved = snapshots.save({"orders": orders.where("o_orderstatus = 'F'")}, folder, "before")
    later = {"orders": orders.where("o_orderstatus = 'O'"), "younger": orders}
    return snapshots.rollback(spark, later, folder, saved)["orders"].select("o_orderkey", "o_totalprice")


# blobs


@query("SELECT sha256(text) AS hash, octet_length(encode(any_value(text))) AS size, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedup(spark, sf_dir):
    return blobs.addressed(_read(spark, sf_dir, "documents"), "text").select("hash", "size", "copies")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def blob_gc_unreferenced(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    used = docs.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat(F.lit(blobs.REFERENCE), F.sha2(F.col("text").cast("binary"), 256)).alias("blob"))
    return blobs.unreferenced(blobs.addressed(docs, "text"), blobs.references(used)).select("hash")


@query("""WITH b AS (SELECT octet_length(encode(any_value(text))) AS size, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))
          SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size * copies) AS BIGINT) AS raw_bytes FROM b""")
def blob_stats(spark, sf_dir):
    return blobs.stats(blobs.addressed(_read(spark, sf_dir, "documents"), "text"))


# documents, changes by key, expiry, differences


@query("""SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total, count(*) AS record_count
          FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 90 GROUP BY 1 HAVING count(*) >= 2""")
def agg_document(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    spec = Aggregate((Metric("n", "count"), Metric("total", "sum", "k")), ("k",), {"k": {"$lt": 90}}, having={"count": {"$gte": 2}})
    return Table(events, "event_id", document="doc").aggregate(spec)[0]


_ANY = """CASE event_id % 5 WHEN 0 THEN CAST(event_id % 11 AS STRING) WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' ELSE '{"a": 1}' END"""


@query("""SELECT event_id FROM events ORDER BY CASE event_id % 5 WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END DESC,
          CASE WHEN event_id % 5 = 0 THEN event_id % 11 END, CASE WHEN event_id % 5 = 1 THEN event_type END, event_id LIMIT 700""")
def sql_order_any(spark, sf_dir):
    rank, number, flag, text_ = tv.variant_order(F.parse_json(F.expr(_ANY)))
    return _read(spark, sf_dir, "events").orderBy(rank.desc(), number, flag, text_, "event_id").limit(700).select("event_id")


@query("SELECT CAST(sum((length(p_name) + 1) * 7) AS BIGINT) AS cells FROM part")
def sql_like_work(spark, sf_dir):
    return _read(spark, sf_dir, "part").agg(F.sum(tv.like_cells(F.col("p_name"), "%cold%")).alias("cells"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'second' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey + 200 ELSE n_nationkey END AS seq FROM nation UNION ALL SELECT n_nationkey + 1000, 'second', n_nationkey + 200 FROM nation")
def dml_upsert_view(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    table = Table(nation.select("n_nationkey", "n_name", F.col("n_nationkey").alias("seq")), "n_nationkey", "seq")
    keys = nation.where("n_regionkey = 1").select("n_nationkey", F.col("n_nationkey").alias("k")).union(nation.select(F.col("n_nationkey") + 1000, "n_nationkey"))
    rows = [keys.select("n_nationkey", F.lit(name).alias("n_name"), (F.col("k") + add).alias("seq")) for name, add in (("first", 100), ("second", 200))]
    return table.put_many(rows[0].union(rows[1])).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def dml_delete_keys(spark, sf_dir):
    returned = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Table(_read(spark, sf_dir, "orders"), "o_orderkey").delete_many(returned).df.select("o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'SWAPPED' ELSE n_name END AS n_name FROM nation")
def dml_swap_if(spark, sf_dir):
    table = Table(_read(spark, sf_dir, "nation"), "n_nationkey")
    done, table, _ = table.swap_if(7, {"n_regionkey": {"$gte": 0}}, {"n_name": "SWAPPED"})
    refused, table, now = table.swap_if(7, {"n_name": "no such name"}, {"n_name": "LOST"})
    if not done or refused or now.first()["n_name"] != "SWAPPED":
        raise AssertionError("a swap that must happen did not, or the other way round")
    return table.df.select("n_nationkey", "n_name")


@query(f"SELECT event_id, 'EXPIRE' AS op FROM events WHERE {_EXPIRY} <= 100")
def ttl_expire_events(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.expr(_EXPIRY).alias("expires_at"))
    return changelog.expired_events(rows, F.lit(100)).select("event_id", "op")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment || '!' END AS segment, CASE WHEN c_custkey % 15 = 0 THEN CAST(c_nationkey + 1 AS VARCHAR) END AS nation
          FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 0""")
def table_diff(spark, sf_dir):
    before = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name")
    after = before.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_mktsegment", F.lit("!"))).otherwise(F.col("c_mktsegment")))
    after = after.withColumn("c_nationkey", F.when(F.col("c_custkey") % 15 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    diff = F.col("diff")
    return coerce.row_diff(before, after, "c_custkey").select("c_custkey", diff["c_mktsegment"]["new"].alias("segment"), diff["c_nationkey"]["new"].alias("nation"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0")
def blob_quarantine(spark, sf_dir):
    return blobs.verified(_stored(spark, sf_dir))[1].select("doc_id")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    return stored.withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.sha2("content", 256)))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE trim(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9)) END AS text FROM conversations""")
def blocks_normalise(spark, sf_dir):
    """Turns as one structured block each: text, unsigned thinking, and signed thinking, which is left alone."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("thinking"), F.lit("thinking")), (F.col("turn") % 3 + 1).cast("int"))
    block = F.struct(kind.alias("type"), F.col("text"), F.when(F.col("turn") % 3 == 2, F.lit("signed")).alias("signature"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise_blocks(F.array(block)).alias("b"))
    return rows.select("conv_id", "turn", F.col("b")[0]["text"].alias("text"))


@query("""SELECT 'table' AS part, 'region' AS name, count(*) AS rows, 0::BIGINT AS problems, 'healthy' AS status FROM region
          UNION ALL SELECT 'table', 'customer', count(*), count(CASE WHEN c_custkey % 7 = 0 THEN 1 END), 'degraded' FROM customer
          UNION ALL SELECT 'blobs', 'blobs', count(*), count(CASE WHEN doc_id % 7 = 0 THEN 1 END), 'degraded' FROM documents WHERE text IS NOT NULL""")
def table_health(spark, sf_dir):
    """A table without a schema, one whose balances may not be null but are, and blobs of which some have another hash."""
    schema = constraints.Schema((constraints.Field("c_custkey", "INTEGER"), constraints.Field("bal", "REAL", False)), "c_custkey")
    tables = {"region": _read(spark, sf_dir, "region"), "customer": _customers(spark, sf_dir).df.select("c_custkey", "bal")}
    return snapshots.health(tables, schemas={"customer": schema}, blobs=_stored(spark, sf_dir))


@query("SELECT 'one' AS label, 'nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'two', 'nation', count(*) FROM nation UNION ALL SELECT 'two', 'region', count(*) FROM region")
def snapshot_list(spark, sf_dir):
    folder = f"{snapshots.shared_folder(spark)}/{uuid.uuid4().hex}"
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    snapshots.save({"nation": nation}, folder, "one")
    snapshots.save({"nation": nation, "region": region}, folder, "two")
    return snapshots.listed(spark, folder).select("label", F.explode("tables").alias("table", "rows"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9)) AS text FROM conversations""")
def blocks_nested(spark, sf_dir):
    """Turns as blocks within the result of a tool."""
    inner = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("signature")))
    block = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("signature"), inner.alias("content"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise_blocks(F.array(block), nested=True).alias("b"))
    return rows.select("conv_id", "turn", F.col("b")[0]["content"][0]["text"].alias("text"))


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def filter_object(spark, sf_dir):
    """A dictionary without operators is no condition."""
    return Table(_read(spark, sf_dir, "part"), "p_partkey").query(Options(Clauses({"p_name": {"first": "cold"}, "p_size": {"$gt": 40}}))).select("p_partkey")


@query(f"SELECT c_custkey AS _key, c_name AS name FROM ({_CUSTOMERS}) WHERE bal > 5000 ORDER BY bal DESC, c_custkey LIMIT 40")
def table_entries(spark, sf_dir):
    rows = _customers(spark, sf_dir).entries(Options(Clauses({"bal": {"$gt": 5000}}), sort=(("bal", "desc"),), limit=40))
    return rows.select("_key", F.col("record.c_name").alias("name"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^cold.*t$')")
def filter_regex_literal(spark, sf_dir):
    return Table(_read(spark, sf_dir, "part"), "p_partkey").query(Options(Clauses({"p_name": re.compile("^cold.*t$")}))).select("p_partkey")


@query("SELECT sha256(text) AS hash, count(*) AS files FROM documents WHERE doc_id < 0 GROUP BY 1 UNION ALL SELECT sha256(r_name), 1 FROM region")
def blob_folder(spark, sf_dir):
    """Blobs stored as files that are named by their hashes, one for each region's name, read back and verified."""
    folder = f"{snapshots.shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    stored = blobs.addressed(_read(spark, sf_dir, "region"), "r_name")
    stored.select("hash", F.col("content").cast("string").alias("value")).write.partitionBy("hash").option("lineSep", "\x00").text(folder)
    read = blobs.read_folder(spark, folder, name=r"hash=([0-9a-f]{64})/[^/]+$").withColumn("content", F.substring("content", F.lit(1), F.octet_length("content") - 1))
    return blobs.verified(read)[0].groupBy("hash").agg(F.count("*").alias("files"))


@query(f"""WITH f AS ({_FRAMES}), c AS (SELECT "table", max(frame_id) AS cl FROM f WHERE op = 'CLEAR' GROUP BY 1),
                l AS (SELECT f.* FROM f LEFT JOIN c USING ("table") WHERE op <> 'CLEAR' AND (cl IS NULL OR frame_id > cl)),
                r AS (SELECT *, row_number() OVER (PARTITION BY "table", "key" ORDER BY frame_id DESC) AS k, max(CASE WHEN op = 'DELETE' THEN frame_id END) OVER (PARTITION BY "table", "key") AS gone FROM l),
                b AS (SELECT "table", "key", min(frame_id) AS inserted FROM r WHERE gone IS NULL OR frame_id > gone GROUP BY ALL)
           SELECT (SELECT max(frame_id) FROM f) + row_number() OVER (ORDER BY inserted) AS frame_id, r."table", r."key", payload FROM r JOIN b USING ("table", "key") WHERE k = 1 AND op <> 'DELETE'""")
def log_compact(spark, sf_dir):
    return changelog.compacted(_frames(spark, sf_dir), 0).select("frame_id", "table", "key", "payload")


# streams


def _stream(spark: SparkSession, sf_dir: str, where: dict | None = None) -> tuple[DataFrame, str]:
    """The frames, deletes without a record, as JSON files in a shared folder, read as a stream; and the folder."""
    folder = f"{snapshots.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a stream's time begins at 0, and what is not after it is late
    _frames(spark, sf_dir).withColumn("payload", F.when(F.col("op") != "DELETE", F.col("payload"))).withColumn("ts", F.col("ts") + 1).write.json(f"{folder}/frames")
    return events.stream(spark, f"{folder}/frames", where), folder


@query(f"""SELECT frame_id, op FROM ({_FRAMES}) WHERE op IN ('CLEAR', 'DELETE') OR CAST(json_extract_string(payload, '$.k') AS BIGINT) > 50""")
def stream_changes(spark, sf_dir):
    """Change events filtered by their record; what carries none is always delivered."""
    rows, folder = _stream(spark, sf_dir, {"k": {"$gt": 50}})
    events.written(rows.select("frame_id", "op"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("frame_id long, op string").parquet(f"{folder}/out")


@query(f"""WITH w AS (SELECT frame_id, op, CASE WHEN op = 'DELETE' THEN NULL ELSE payload END AS payload, "table", "key" FROM ({_FRAMES}) WHERE op <> 'CLEAR'),
                b AS (SELECT *, lag(payload) OVER (PARTITION BY "table", "key" ORDER BY frame_id) AS before FROM w)
           SELECT frame_id, op, before FROM b WHERE coalesce(payload, before) IS NULL OR CAST(json_extract_string(coalesce(payload, before), '$.k') AS BIGINT) > 50""")
def stream_before(spark, sf_dir):
    """Writes filtered by their record or, for deletes, by the record that state holds of the key."""
    rows, folder = _stream(spark, sf_dir)
    found = events.matching(events.with_before(rows), {"k": {"$gt": 50}}).select("frame_id", "op", "before")
    events.written(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("frame_id long, op string, before string").parquet(f"{folder}/out")


@query(f"""SELECT "table", "key", max(frame_id) AS frame_id, arg_max(op, frame_id) AS op, arg_max(CASE WHEN op = 'DELETE' THEN 'none' ELSE payload END, frame_id) AS payload FROM ({_FRAMES}) WHERE op <> 'CLEAR' GROUP BY ALL""")
def stream_current(spark, sf_dir):
    """The last write of every key, kept by a streaming aggregate."""
    rows, folder = _stream(spark, sf_dir)
    now = events.current(rows)
    events.written(now, f"{folder}/out", f"{folder}/checkpoint", mode="complete")
    return spark.read.schema(now.schema).parquet(f"{folder}/out").withColumn("payload", F.coalesce("payload", F.lit("none")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
