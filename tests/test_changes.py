import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import BindingsError, ResourceLimitError, SchemaError
from tessera.functions import coerce, text
from tessera.operators import changelog, constraints
from tessera.operators import threevalued as tv
from tessera.operators.query import Table
from tessera.sources import blobs, snapshots
from tessera.streaming import events


def chain(rows):
    """Frames with right checksums, by the rule in plain Python."""
    import hashlib

    out, previous = [], changelog.GENESIS
    for i, (op, table, key, payload) in enumerate(rows, 1):
        digest = hashlib.sha256(f"{i}:{i * 10}:{op}:{table}:{key}:{payload or '{}'}:{previous}".encode()).hexdigest()
        out.append((i, i * 10, op, table, key, payload, digest, previous))
        previous = digest
    return out


LOG = [("INSERT", "t", "a", '{"x":1}'), ("INSERT", "t", "b", '{"x":2}'), ("UPDATE", "t", "a", '{"x":3,"y":"é"}'), ("DELETE", "t", "b", None), ("INSERT", "t", "b", '{"x":9}'), ("INSERT", "u", "a", '{"x":0}'), ("CLEAR", "u", "*", None), ("CHECKPOINT", "*", "*", None)]


def test_replay_and_chain(spark):
    frames = spark.createDataFrame(chain(LOG), changelog.FRAME)
    assert changelog.verified(frames).count() == 8
    rows = {(r.table, r.key): (json.loads(r.payload)["x"], r.frame_id, r.inserted) for r in changelog.replay(frames).collect()}
    assert rows == {("t", "a"): (3, 3, 1), ("t", "b"): (9, 5, 5)}
    diff = changelog.differences(frames).collect()
    assert [(d.frame_id, d.diff["x"].old, d.diff["x"].new, d.diff["y"].old) for d in diff] == [(3, "1", "3", None)]


@pytest.mark.parametrize(("change", "why"), [((2, "payload", '{"x":7}'), "checksum"), ((3, "previous", "0" * 64), "link"), ((1, "previous", "1" * 64), "link"), ((4, "op", "DROP"), "op"), ((5, "checksum", None), "form"), ((5, "key", None), "form"), ((2, "payload", "[1]"), "form"), ((2, "payload", "{"), "form")])
def test_a_changed_frame_is_named(spark, change, why):
    names = [f.name for f in changelog.FRAME]
    rows = [dict(zip(names, r, strict=True)) for r in chain(LOG)]
    rows[change[0] - 1][change[1]] = change[2]
    frames = spark.createDataFrame([tuple(r.values()) for r in rows], changelog.FRAME)
    assert (change[0] if change[1] != "frame_id" else None, why) in [(r.frame_id, r.why) for r in changelog.violations(frames).collect()]
    with pytest.raises(changelog.LogIntegrityError):
        changelog.verified(frames)
    gap = spark.createDataFrame([r for r in chain(LOG) if r[0] != 5], changelog.FRAME)
    assert [(r.frame_id, r.why) for r in changelog.violations(gap).collect()] == [(6, "gap")]
    twice = spark.createDataFrame([*chain(LOG), chain(LOG)[3]], changelog.FRAME)
    assert [(r.frame_id, r.why) for r in changelog.violations(twice).collect()] == [(4, "twice")] * 2
    assert changelog.violations(spark.createDataFrame([], changelog.FRAME)).collect() == []


def test_files_with_a_torn_tail_and_a_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    names = [f.name for f in changelog.FRAME]
    lines = []
    for r in chain(LOG):
        d = dict(zip(names, r, strict=True))
        payload = d.pop("payload")
        head = json.dumps({k: d[k] for k in ("frame_id", "ts", "op", "table", "key")}, separators=(",", ":"))[:-1]
        lines.append(head + (f',"payload":{payload}' if payload else "") + f',"checksum":"{d["checksum"]}","previous":"{d["previous"]}"}}')
    (folder / "a.json").write_text("\n".join(lines) + '\n{"frame_id":9,"ts"')
    frames = changelog.torn_tail(changelog.read_frames(spark, str(folder)))
    assert changelog.verified(frames).count() == 8 and changelog.replay(frames).count() == 2
    # only an unfinished last line that is no JSON goes: not one with a line end, not one in the middle, not one that is whole
    for text_, kept in (("\n".join(lines) + '\n{"frame_id":9,"ts"\n', 9), ("\n".join([*lines[:4], "garbage", *lines[4:]]) + "\n", 9), ("\n".join(lines), 8), ("\n\n" + "\n".join(lines) + "\n\n", 8), ('{"x', 0)):
        other = tmp_path / f"log{abs(hash(text_))}"
        other.mkdir()
        (other / "a.json").write_text(text_)
        rows = changelog.torn_tail(changelog.read_frames(spark, str(other)))
        assert rows.count() == kept
        if kept == 9:
            with pytest.raises(changelog.LogIntegrityError, match="frame None: form"):
                changelog.verified(rows)
    got = []
    query = events.subscribe(events.stream(spark, str(folder), {"x": {"$gte": 2}}), lambda df, n: got.extend(r.frame_id for r in df.collect()), str(tmp_path / "cp"), once=True)
    query.awaitTermination(60)
    assert sorted(i for i in got if i and i < 9) == [2, 3, 4, 5, 7, 8]  # 4 and 8 carry no record


def test_expiry(frame):
    rows = frame([(1, None), (2, 50), (3, 51)], "id int, expires_at int")
    assert [r.id for r in changelog.live_rows(rows, F.lit(50)).orderBy("id").collect()] == [1, 3]
    assert [r.op for r in changelog.expired_events(rows, F.lit(50)).collect()] == ["EXPIRE"]


def test_constraints(frame):
    schema = constraints.Schema((constraints.Field("id", "INTEGER"), constraints.Field("name", "TEXT", False), constraints.Field("j", "JSON"), constraints.Field("note", "TEXT", default="n")), "id", (("name",),))
    good = constraints.checked(frame([(1, "a", '{"a":1}'), (2, "b", None)], "id long, name string, j string"), schema)
    assert [r.note for r in good.collect()] == ["n", "n"]
    for rows in ([(None, "a", None)], [(1, None, None)], [(1, "a", "{")], [(1, "a", None), (1, "b", None)], [(1, "a", None), (2, "a", None)], [(2**53, "a", None)]):
        with pytest.raises(constraints.ConstraintError):
            constraints.checked(frame(rows, "id long, name string, j string"), schema)
    with pytest.raises(constraints.ConstraintError):
        constraints.checked(frame([(1, "a", 3)], "id long, name string, z int"), schema)
    with pytest.raises(constraints.ConstraintError):
        constraints.Schema((constraints.Field("id", "REAL"),), "id")


def test_snapshots(spark, frame, tmp_path):
    folder = str(tmp_path / "snaps")
    a, b = frame([(1, "x"), (2, None)], "id int, s string"), frame([(3,)], "id int")
    id_ = snapshots.save({"a": a}, folder, "one")
    back = snapshots.rollback(spark, {"a": b, "later": b}, folder, id_)
    assert sorted(back["a"].collect()) == sorted(a.collect()) and back["later"].count() == 1
    a.limit(1).write.mode("append").parquet(f"{folder}/{id_}/tables/a")
    with pytest.raises(snapshots.SnapshotIntegrityError):
        snapshots.load(spark, folder, id_)
    for bad in ("../x", "0" * 32):
        with pytest.raises(snapshots.SnapshotIntegrityError):
            snapshots.load(spark, folder, bad)
    broken = constraints.Schema((constraints.Field("id", "INTEGER"), constraints.Field("s", "TEXT", False)), "id", (("s",),))
    frames = spark.createDataFrame([r for r in chain(LOG) if r[0] != 5], changelog.FRAME)
    health = {r.name: (r.part, r.rows, r.problems, r.status) for r in snapshots.health({"a": a, "b": b}, schemas={"a": broken}, frames=frames).collect()}
    assert health == {"a": ("table", 2, 1, "degraded"), "b": ("table", 1, 0, "healthy"), "frames": ("log", 7, 1, "degraded")}
    later = snapshots.save({"b": b}, folder, "two", at=1 << 42, frame=7, schemas={"b": broken})
    assert [(r.id, r.frame) for r in snapshots.listed(spark, folder).collect()] == [(later, 7), (id_, None)]
    assert snapshots.load_schemas(spark, folder, later) == {"b": broken}
    for name, text_ in (("old", '{"settings":[{"id":"x","enabled":true}]}'), ("new", '{"formatVersion":1,"tables":{"settings":[{"id":"x","record":{"enabled":true}}]}}')):
        (tmp_path / name).write_text(text_)
        assert [(r.key, json.loads(r.record)["enabled"]) for r in snapshots.read_records(spark, str(tmp_path / name), "settings").collect()] == [("x", True)]


def test_blobs(frame):
    found = blobs.addressed(frame([("x",), ("x",), ("yy",), (None,)], "content string"))
    assert sorted((r.size, r.copies) for r in found.collect()) == [(1, 2), (2, 1)]
    assert blobs.stats(found).first().asDict() == {"blobs": 2, "bytes": 3, "raw_bytes": 4}
    hash_x = found.where("size = 1").first().hash
    refs = blobs.references(frame([(1, "CAS:" + hash_x), (2, "CAS:zz")], "id int, r string"))
    assert [r.size for r in blobs.unreferenced(found, refs).collect()] == [2]
    good, bad = blobs.verified(found.withColumn("hash", F.when(F.col("size") == 2, "0").otherwise(F.col("hash"))))
    assert (good.count(), bad.count()) == (1, 1)


def test_three_values(frame):
    from pyspark.sql import types as T

    df = frame([(1, 5.0, "aB\\c\nd"), (2, None, None), (3, 20.0, "É")], "id int, x double, s string")
    one = lambda c: [r[0] for r in df.select(c.alias("c"), "id").orderBy("id").collect()]
    D, S = T.DoubleType(), T.StringType()
    assert one(tv.compare(F.col("x"), D, "=", "5")) == [None] * 3
    assert one(tv.is_in(F.col("x"), D, [5.0, None])) == [True, None, None]
    assert one(tv.is_in(F.col("x"), D, ["5"])) == [False, None, False]
    assert one(tv.between(F.col("x"), D, 10.0, None, True)) == [None] * 3
    assert one(tv.between(F.col("x"), D, 10.0, 30.0, True)) == [True, None, False]
    assert one(tv.like(F.col("s"), "Ab\\%D")) == [True, None, False]
    assert one(tv.like(F.col("s"), "é")) == [False, None, False]
    assert one(tv.like(F.col("s"), "_")) == [False, None, True]
    assert one(tv.compare(F.col("s"), S, ">", "a")) == [True, None, True]
    assert one(tv.compare_json(F.lit('{"b":1.0,"a":[1]}'), ">=", '{"a":[1],"b":1}')) == [True] * 3
    assert one(tv.compare_json(F.lit("1"), "<", "2")) == [None] * 3


def test_text(frame):
    df = frame([("a\r\n\r\n\r\n\r\nb  c\t\td ﻿", "user"), (" x \n\n y ", "system"), (None, "user"), ("😀" * 5, "user")], "t string, r string")
    got = [r[0] for r in df.select(text.normalise(F.col("t"), F.col("r"))).collect()]
    assert got[:3] == ["a\n\nb c d", "x \n\n y", None]
    assert [r[0] for r in df.select(text.estimate_tokens(F.col("t"))).collect()][2:] == [0, 3]
    blocks = frame([([("text", "a  b", None), ("thinking", "a  b", "sig"), ("image", "a  b", None)],)], "b array<struct<type:string,text:string,signature:string>>")
    assert [x.text for x in blocks.select(text.normalise_blocks(F.col("b")).alias("b")).first().b] == ["a b", "a  b", "a  b"]


def test_numbers_of_text(frame):
    cases = {"12": 12, " 12 ": 12, "": 0, "\n": 0, "0x10": 16, "0b101": 5, "0o17": 15, "1e3": 1000, ".5": 0.5, "5.": 5, "-Infinity": float("-inf"), "abc": None, "1d": None, "inf": None, "1_0": None, "0x": None, "+-1": None}
    got = {r.s: r.n for r in frame([(k,) for k in cases], "s string").select("s", coerce.number_of_text(F.col("s")).alias("n")).collect()}
    assert got == cases


def test_row_diff(frame):
    a, b = frame([(1, "x", 2), (2, "y", None), (3, "z", 1)], "id int, s string, n int"), frame([(1, "x", 3), (2, "y", None)], "id int, s string, n int")
    assert [(r.id, {k: tuple(v) for k, v in r["diff"].items()}) for r in coerce.row_diff(a, b, "id").collect()] == [(1, {"n": ("2", "3")})]


def test_differences_of_types_nulls_clears_and_hot_keys(spark):
    rows = [("INSERT", "t", "a", '{"a":1}'), ("UPDATE", "t", "a", '{"a":"1"}'), ("UPDATE", "t", "a", '{"a":"1","b":null}'), ("CLEAR", "t", "*", None), ("INSERT", "t", "a", '{"a":7}'), ("UPDATE", "t", "a", '{"a":7.0}'), ("DELETE", "t", "a", None), ("INSERT", "t", "a", '{"a":8}'), ("INSERT", "u", "a", '{"a":[1]}'), ("UPDATE", "u", "a", '{"a":[1,2]}')]
    frames = spark.createDataFrame(chain(rows), changelog.FRAME)
    for span in (1 << 18, 2, 3):
        got = {r.frame_id: {k: tuple(v) for k, v in r["diff"].items()} for r in changelog.differences(frames, span).collect()}
        assert got == {2: {"a": ("1", '"1"')}, 3: {"b": (None, "null")}, 10: {"a": ("[1]", "[1,2]")}}
        before = {r.frame_id: r.before for r in changelog.with_before(frames, span).collect()}
        assert before == {1: None, 2: '{"a":1}', 3: '{"a":"1"}', 5: None, 6: '{"a":7}', 7: '{"a":7.0}', 8: None, 9: None, 10: '{"a":[1]}'}


def test_a_compacted_log_replays_to_the_same_rows(spark):
    frames = spark.createDataFrame(chain(LOG), changelog.FRAME)
    new = changelog.compacted(frames, 99)
    rows = lambda f: [(r.table, r.key, r.payload) for r in changelog.replay(f).orderBy("inserted").collect()]
    assert rows(new) == rows(frames) and [r.frame_id for r in new.orderBy("frame_id").collect()] == [9, 10]


def test_expiry_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda i, ts, key, end: json.dumps({"frame_id": i, "ts": ts, "op": "INSERT" if end is not False else "DELETE", "table": "t", "key": key, "payload": None if end is False else json.dumps({"v": i} | ({"end": end} if end else {}))})
    (folder / "0.json").write_text("\n".join([put(1, 1000, "a", 5000), put(2, 1000, "b", 3000), put(3, 2000, "b", None), put(4, 2000, "c", 2500), put(5, 4000, "c", 9000)]))
    got = []

    def run():
        rows = events.with_before(events.stream(spark, str(folder)), expires="end")
        events.subscribe(rows, lambda df, n: got.extend((r.frame_id, r.ts, r.op, r.key, r.before and json.loads(r.before)["v"]) for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)

    run()
    assert sorted(x[0] for x in got if x[0]) == [1, 2, 3, 4, 5] and (None, 2500, "EXPIRE", "c", 4) in got and (3, 2000, "INSERT", "b", 2) in got
    (folder / "1.json").write_text(put(6, 6000, "z", None))
    run()
    (folder / "2.json").write_text(put(7, 7000, "a", False))
    run()
    assert (None, 5000, "EXPIRE", "a", 1) in got and (7, 7000, "DELETE", "a", None) in got
    assert sum(x[2] == "EXPIRE" for x in got) == 2


def test_keys_of_a_stream_share_states(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda i, ts, key, end=None: json.dumps({"frame_id": i, "ts": ts, "op": "UPDATE", "table": "t", "key": key, "payload": json.dumps({"v": i} | ({"end": end} if end else {}))})
    (folder / "0.json").write_text("\n".join([put(i, i, f"k{i % 300}", 2000 if i == 601 else None) for i in range(1, 602)]))
    got = []

    def run():
        rows = events.with_before(events.stream(spark, str(folder)), expires="end", groups=4)
        query = events.subscribe(rows, lambda df, n: got.extend((r.frame_id, r.op, r.key, r.before and json.loads(r.before)["v"]) for r in df.collect()), str(tmp_path / "cp"), once=True)
        query.awaitTermination(120)
        return query

    assert run().lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    assert sorted(x[0] for x in got) == list(range(1, 602))
    assert {x[0]: x[3] for x in got} == {i: i - 300 if i > 300 else None for i in range(1, 602)}
    # every group has frames while the record of k1 ends: they do not put off its end
    for n, ts in ((1, 3000), (2, 4000)):
        (folder / f"{n}.json").write_text("\n".join(put(1000 * n + i, ts, f"k{i}") for i in range(2, 300)))
        run()
    assert [x for x in got if x[1] == "EXPIRE"] == [(None, "EXPIRE", "k1", 601)]
    assert {x[0]: x[3] for x in got if x[0] and x[0] > 2000} == {2000 + i: 1000 + i for i in range(2, 300)}


def test_a_table_bound_to_a_schema(frame):
    schema = constraints.Schema((constraints.Field("id", "INTEGER"), constraints.Field("name", "TEXT", False), constraints.Field("note", "TEXT", default="n")), "id", (("name",),))
    kind = "id long, name string, note string"
    table = Table(frame([(1, "a", "x"), (2, "b", "y")], kind), "id", schema=schema)
    rows = lambda t: sorted(tuple(r) for r in t.df.collect())
    assert rows(table.insert(frame([(3, "c")], "id long, name string"))) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "n")]
    for bad in (lambda: table.insert(frame([(1, "c", "n")], kind)), lambda: table.insert(frame([(3, "c", "n"), (3, "d", "n")], kind)), lambda: table.insert(frame([(3, "a", "n")], kind)), lambda: table.put_many(frame([(3, "a", "n")], kind)), lambda: table.put_many(frame([("3", "c", "n")], "id string, name string, note string")), lambda: table.update_where({"id": 1}, {"name": "b"}), lambda: table.update_where({"id": 1}, {"id": 5}), lambda: table.transaction(lambda t: t.update_where({}, {"name": "z"}))):
        with pytest.raises(constraints.ConstraintError):
            bad()
    swap = lambda t: t.update_where({"id": 1}, {"name": "b"}).update_where({"id": 2}, {"name": "a"}).delete_many(frame([(9,)], "id long"))
    assert rows(table.transaction(swap)) == [(1, "b", "x"), (2, "a", "y")] and rows(table) == [(1, "a", "x"), (2, "b", "y")]
    found, after, now = table.swap_if(1, {"name": "zz"}, {"name": "q"})
    assert not found and after is table and now.first()["name"] == "a"
    assert table.clear().count() == 0 and table.put_many(frame([(1, "q", "a"), (1, "q", "b")], kind)).count() == 2


def test_expiry_of_a_table(frame):
    table = Table(frame([(1, 50), (2, None)], "id int, expires_at int"), "id")
    assert [r.id for r in table.live(50).df.collect()] == [2]
    assert sorted(r.id for r in table.put_many(frame([(1,)], "id int")).live(50).df.collect()) == [1, 2]  # a plain put ends it never


def test_statements(spark, frame):
    v = frame([(1, "x")], "id int, s string")
    assert tv.select(spark, "SELECT '{v}' AS a, `{v}` AS b, s /* {v} ? */ FROM {v} CROSS JOIN (SELECT 1 AS `{v}`) WHERE id = ? -- {v}?", [1], v=v).first().asDict() == {"a": "{v}", "b": 1, "s": "x"}
    assert not spark.catalog.listTables()
    for statement, parameters, error in (("SELECT id, s AS ID FROM {v}", None, SchemaError), ("SELECT * FROM {w}", None, SchemaError), ("SELECT * FROM {v} WHERE id = ?", None, BindingsError), ("SELECT * FROM {v}", [1], BindingsError)):
        with pytest.raises(error):
            tv.select(spark, statement, parameters, v=v)
    texts = frame([("😀" * 10,), (None,), ("ab",)], "s string")
    assert [r[0] for r in texts.select(tv.like_cells(F.col("s"), "%a")).collect()] == [63, None, 9]
    assert tv.within_budget(texts, [(F.col("s"), "%a")], 72) is texts
    with pytest.raises(ResourceLimitError) as e:
        tv.within_budget(texts, [(F.col("s"), "%a")], 71)
    assert e.value.code == "RESOURCE_LIMIT"


def test_compaction(frame):
    rows = frame([(1, "user", "a" * 12 + "  \n\n\n\n" + "b" * 12, "s   s"), (1, "system", "x \n\n\n y", "s   s"), (2, "user", "", None), (3, "user", None, None)], "conv_id int, role string, text string, system string")
    got = {r.conv_id: r.asDict() for r in text.compact(rows, system="system").collect()}
    assert got[1] == {"conv_id": 1, "tokens_before": 12, "tokens_after": 10, "tokens_saved": 2, "percent_saved": 16.67}
    assert got[2]["percent_saved"] == got[3]["percent_saved"] == 0.0 and got[3]["tokens_before"] == 0
    assert {(r.text, r.system) for r in text.compacted(rows, system="system").collect()} == {("a" * 12 + " \n\n" + "b" * 12, "s s"), ("x \n\n\n y", "s s"), ("", None), (None, None)}
    import hashlib

    hashes = {r.conv_id: r.prompt_sha256 for r in text.prompt_hash(rows.withColumn("turn", F.lit(1)), system="system").collect()}
    assert hashes[2] == hashlib.sha256(b'{"systemPrompt":null,"messages":[{"role":"user","content":""}]}').hexdigest() and len(hashes) == 3


def test_explain(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    plan = Table.from_parquet(spark, str(tmp_path / "t"), "id").select().where("id").greater_than(90).explain()
    assert (plan.strategy, plan.candidates, plan.matched) == ("pushed filters", 100, 9) and any("GreaterThan(id,90)" in p for p in plan.pushed)
