"""The pipeline, stage by stage, against what each stage promises; and its queries' contracts on the smallest tables."""

import os
import zlib

import pytest

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark, tokenizer):
    from tessera.llm import jaccard, packing
    from tessera.llm.scratch import written

    docs = queries.table(spark, DATA, "documents")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, DATA), name)
        assert after.columns == docs.columns
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(b) <= set(a)
        if name == "near_duplicates":
            groups = jaccard.near_duplicates(before).collect()
            assert set(b) == {r.class_id for r in groups}
        if name == "secrets":
            assert set(a) == set(b) and all(r.n_chars == len(r.text) for r in b.values())
            assert any("[SECRET]" in r.text for r in b.values()) == any(a[i].text != b[i].text for i in a)
        else:
            assert all(b[i] == a[i] for i in b)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text or "") for r in b.values()) and len(b) >= len(a) - 2
        kept[name], before = b, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert {r.doc_id for r in pieces} == set(kept["secrets"])
    tokens = {}
    for r in pieces:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 4096
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces)
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces)
    assert packing


def test_language_contract(spark):
    rows = queries.op2_language_id(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    lang = {r.doc_id: r.lang for r in queries.table(spark, DATA, "documents").collect()}
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.queries()[name](spark, DATA)
        got = [tuple(r) for r in df.collect()]
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        key = lambda r: [str(v) for v in r]
        assert sorted(got, key=key) == sorted((tuple(r[names.index(c)] for c in df.columns) for r in want.fetchall()), key=key), name


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_take_odd_rows_and_clashing_columns(spark, odd, empty, which, tmp_path):
    docs = {"odd": odd, "empty": empty}[which]
    names = ["__key", "key", "lang_pred", "n_grams", "class_id", "links", "copies", "item_id", "c0", "c1", "h", "__id"]
    docs = docs.withColumns({c: docs.n_chars for c in names})
    spark.createDataFrame([(1, "word"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(str, df.collect()))
    given = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    if which == "empty":
        assert all(stage(spark, docs, str(tmp_path)).count() == 0 for stage in stages.values())
        return
    ids = lambda name: sorted((r.doc_id for r in stages[name](spark, docs, str(tmp_path)).collect()), key=str)
    assert ids("language_id") == [1, 1, 5, 6, 7, 8]  # those without a letter go, and that of a language which was not learned
    assert ids("near_duplicates") == [1, 2, 3, 4, 5, 7, 8, None]  # 6 is like 1, whose repeated row goes
    assert ids("decontamination") == [1, 1, 2, 3, 4, 6, 7, 8, None]  # 5 is the item
    assert len(rows(stages["secrets"](spark, docs, str(tmp_path)))) == len(given)
    assert {r.doc_id for r in stages["packing"](spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, None}
