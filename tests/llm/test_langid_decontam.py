import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid
from tessera.llm import words as W


def text_of(language, rng, n=80):
    parts = {"xx": ["ka", "ro", "mi", "te", "lu"], "yy": ["sch", "und", "er", "ge", "ung"], "zz": ["ção", "que", "de", "os", "ar"]}[language]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, text_of(x, rng), x) for i in range(300) for x in [("xx", "yy", "zz")[i % 3]]], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, labelled):
    filters = langid.fit(labelled.where("doc_id < 200"))
    got = langid.identify(labelled.where("doc_id >= 200"), filters, keep=("lang",)).collect()
    assert len(got) == 100 and all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got)


def test_filters_hold_every_gram_and_know_their_errors():
    rng = np.random.default_rng(1)
    sets = {str(i): rng.integers(0, 1 << 63, 2000).astype(np.uint64) for i in range(70)}
    f = langid.Filters.build(sets)
    for k, name in enumerate(f.languages):
        assert (f.containing(sets[name])[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1)).all()
    other = f.containing(rng.integers(0, 1 << 63, 40000).astype(np.uint64))
    wrong = float(np.mean(other[:, 0] >> np.uint64(3) & np.uint64(1)))
    assert abs(wrong - f.fill[3] ** langid.HASHES) < 0.003


def test_grams_against_a_plain_count():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é1. \n中") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    hashes, ends, has = langid.grams(texts)
    for i, t in enumerate(texts):
        plain = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        while "  " in plain:
            plain = plain.replace("  ", " ")
        assert ends[i + 1] - ends[i] == max(0, len(plain) - langid.N + 1), (t, plain)
        one, _, _ = langid.grams([t])
        assert (one == hashes[ends[i] : ends[i + 1]]).all() and has[i] == any(c.isalpha() for c in t)


def test_language_odd_rows(odd, empty, labelled):
    filters = langid.fit(labelled)
    got = langid.identify(odd, filters)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and rows[2].score == 0 and rows[5].lang_pred in filters.languages
    assert got.count() == 10
    assert langid.identify(empty, filters).collect() == []
    none = langid.fit(labelled.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.fit(odd).languages == ["de", "en", "fr"]


def test_masks_survive_two_substitutions():
    def hit(bad, length=16):
        return any(not any(m[i] == "1" and s + i in bad for i in range(decontam.SPAN)) for m in decontam.MASKS for s in range(length - decontam.SPAN + 1))

    missed = [b for b in itertools.combinations(range(16), 2) if not hit(b)]
    assert all(hit((b,)) for b in range(16)) and len(missed) <= 1


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    items = [" ".join(f"q{rng.randint(0, 5000)}" for _ in range(n)) for n in (15, 20, 40, 60)] + ["too short", None, ""]
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), items


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_are_found_and_clean_texts_left(spark, bench, most):
    frame, items = bench
    rng = random.Random(4)
    filler = lambda n: " ".join(f"f{rng.randint(0, 5000)}" for _ in range(n))
    docs, want = [], set()
    for i in range(60):
        if i % 3 == 0:
            docs.append((i, filler(200)))
            continue
        item = rng.randrange(4)
        words = items[item].split()
        for k in range(0, len(words), 9):  # every ninth word is another
            if i % 3 == 2:
                words[k] = "other"
        docs.append((i, f"{filler(50)} {' '.join(words).upper()}!! {filler(30)}"))
        want.add((i, item))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), frame, most_broadcast=most).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if r.doc_id % 3 == 1]
    assert all(r.matches == r.item_words == r.length and r.doc_start == 50 and r.item_start == 0 for r in exact)


@pytest.mark.parametrize("most", [10**6, 0])
def test_every_overlap_that_the_verdict_accepts_is_found(spark, most):
    rng = random.Random(12)
    sizes = [*range(3, 17), 24, 40]  # those of fewer than nine words are found whole
    items = [[f"q{rng.randint(0, 10**6)}" for _ in range(n)] for n in sizes for _ in range(8)]
    docs = []
    for words in items:
        for lost in range(min(len(words) // 2, 14)):
            own = list(words)
            for k in rng.sample(range(len(own)), lost):
                own[k] = f"other{k}"
            docs.append([f"f{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9))] + own + ["tail"] * rng.randint(0, 3))
    number = lambda w: np.array([hash(x) & (1 << 62) - 1 for x in w], np.uint64)
    a, b = [number(w) for w in docs], [number(w) for w in items]
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if len(np.intersect1d(x, y)) >= min(decontam.LEAST, len(y)):
                if best := max(filter(None, (decontam.verdict(x, y, s) for s in range(-len(y) + 1, len(x)))), default=None):
                    want[i, j] = best[0]
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.matches for r in decontam.leaks(*frames, most_broadcast=most).collect()}
    assert got == want
    assert {len(items[j]) for _, j in want} == set(sizes) and sum(len(items[j]) < 12 for _, j in want) > 30


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_odd_rows(odd, empty, bench, most, spark):
    frame, _ = bench
    assert decontam.leaks(odd, frame, most_broadcast=most).count() == 0
    assert decontam.leaks(empty, frame, most_broadcast=most).count() == 0 == decontam.leaks(odd, frame.limit(0), most_broadcast=most).count()
    own = odd.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text")
    got = decontam.leaks(odd, own.limit(1), most_broadcast=most).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 6] and {r.matches for r in got} == {120, 119}


def test_best_overlap_against_every_stretch():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 3, 12).astype(np.uint64), rng.integers(0, 3, 12).astype(np.uint64)
        start, length, matches = decontam.best_overlap(a, b, 2, 0)
        score = lambda s, e: sum(1 if a[i] == b[i - 2] else -decontam.MISMATCH for i in range(s, e))
        assert score(start, start + length) == max(score(s, e) for s in range(2, 13) for e in range(s, 13) if e <= 12)
        assert matches == sum(a[i] == b[i - 2] for i in range(start, start + length))


def test_words_and_shingles_of_any_segmenting(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1é .\n😀") for _ in range(rng.randint(0, 120))) for _ in range(80)] + [None, ""]
    whole = W.word_hashes(texts)
    monkeypatch.setattr(W, "SEGMENT", 40)
    cut = W.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    for i, t in enumerate(texts):
        n = len("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
        assert whole[1][i + 1] - whole[1][i] == n
    s, ends = W.shingles(*whole)
    counts = np.diff(whole[1])
    assert (np.diff(ends) == np.where(counts >= 5, counts - 4, np.minimum(counts, 1))).all() and len(s) == ends[-1]


def test_n_grams_of_a_long_text_are_those_of_the_whole():
    rng = random.Random(8)
    for alphabet in ("ab é.", "a ", "a....", "abcdefgh", "12 .", "ß中文 x"):
        for n in (0, 1, 3, 30, 200):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            whole, _, letters = langid.grams([text])
            for most in (1, 2, 5, 17):
                parts = [langid.grams(*group) for _, group in langid._grouped([text, "next one"], most)]
                got = np.concatenate([p[0] for p in parts])
                assert (got == np.concatenate((whole, langid.grams(["next one"])[0]))).all(), (text, most)
                assert any(p[2].any() for p in parts)


def test_a_column_named_as_a_result_stays(spark, labelled):
    filters = langid.fit(labelled)
    rows = labelled.limit(3).withColumn("score", F.lit("mine")).withColumn("n_grams", F.lit(1))
    got = langid.identify(rows, filters, keep=("lang", "score", "n_grams"))
    assert got.columns == ["doc_id", "lang", "score", "n_grams", "lang_pred", "score", "n_grams"] and {r[2] for r in got.collect()} == {"mine"}


@pytest.mark.parametrize("most", [10**6, 0])
def test_a_seed_that_many_items_and_texts_share(spark, most):
    """Above the limit of a broadcast too, with one run of words in every item and every text."""
    rng = random.Random(14)
    line = [f"l{i}" for i in range(10)]
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    items = [some(3) + line + some(2) for _ in range(40)]
    docs = [some(20) + (items[i % 40] if i % 2 else line) + some(20) for i in range(120)]
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.matches for r in decontam.leaks(*frames, most_broadcast=most).collect()}
    assert len(got) == 120 * 40 and all(m == (15 if d % 2 and d % 40 == i else 10) for (d, i), m in got.items())
