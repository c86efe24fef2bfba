"""Joins and passages against brute force."""

import random
from collections import defaultdict
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tessera.llm import jaccard, passages
from tessera.llm import words as W
from tessera.llm.components import Forest, components


def split(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus(rng, n, edit=(0, 1, 3, 8, 20)):
    """Texts in families: copies, near copies of several degrees, and texts of their own that share a passage."""
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice(edit)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.1:
                w[1:1] = shared
            out.append(" ".join(w))
    return out[:n]


def brute(texts, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links, root = dict.fromkeys(texts, 0), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


@pytest.mark.parametrize("block", [4, 512])
def test_join_equals_brute_force(spark, block):
    texts = dict(enumerate(corpus(random.Random(1), 250)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == brute(texts)


def test_join_odd_rows(odd, empty):
    rows = jaccard.near_duplicates(odd).collect()
    got = sorted((str(r.doc_id), str(r.class_id), r.links, r.copies) for r in rows)
    assert len(rows) == 10 and got.count(("1", "1", 2, 2)) == 2 and ("6", "1", 2, 1) in got
    assert {(r.doc_id, r.class_id, r.links) for r in rows if r.n_shingles == 0} == {(i, i, 0) for i in (2, 3, 4)}
    assert [r.n_shingles for r in rows if r.doc_id == 5] == [1] and jaccard.near_duplicates(empty).collect() == []


def test_pruning_follows_the_posterior():
    least = jaccard.least_matches(0.8, 1e-6)
    for n, m in zip(jaccard.STEPS, least, strict=True):
        # the posterior by integration of s^m (1-s)^(n-m) over a fine grid
        s = (np.arange(200000) + 0.5) / 200000
        mass = lambda k: (np.where(s >= 0.8, s**k * (1 - s) ** (n - k), 0).sum() / (s**k * (1 - s) ** (n - k)).sum())  # noqa: E731, B023
        assert mass(m) >= 1e-6 * 0.9 and (m == 0 or mass(m - 1) < 1e-6 * 1.1)
    lost = sum(comb(16, k) * 0.8**k * 0.2 ** (16 - k) for k in range(least[0]))
    assert lost < 1e-3


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = both[:900], both[100:]
    sig = jaccard.signatures(np.concatenate((a, b)), np.array([0, 900, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.15


def test_shared_counts_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = jaccard.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(30), 2))
    f = Forest(10)
    f.add(np.array([7, 3, 9]), np.array([5, 4, 7]))
    f.add(np.array([5]), np.array([1]))
    assert dict(zip(*(x.tolist() for x in f.edges()))) == {4: 3, 5: 1, 7: 1, 9: 1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(1, 1), (None, 3)]
    f = Forest(500)
    f.add(*(np.array([e[k] for e in edges if None not in e]) for k in (0, 1)))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert got == {i: int(f.root[i]) for i in touched}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_windows(values, bounds, length):
    out = set()

    def walk(low, high):
        if high - low + 1 >= length:
            c = min(range(low, high + 1), key=lambda i: (int(values[i]), i))
            out.add((c, low, high))
            walk(low, c - 1)
            walk(c + 1, high)

    for a, b in zip(bounds[:-1], bounds[1:]):
        walk(int(a), int(b) - 1)
    return out


@pytest.mark.parametrize("length", [1, 2, 7, 46])
def test_windows_are_the_nodes_of_the_cartesian_tree(length):
    rng = np.random.default_rng(length)
    for _ in range(40):
        bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 120, rng.integers(1, 6)))))
        values = rng.integers(0, 1 << 63, bounds[-1]).astype(np.uint64)
        got = passages.compact_windows(values, bounds, length)
        assert set(zip(*(x.tolist() for x in got))) == plain_windows(values, bounds, length)
    assert len(passages.compact_windows(np.empty(0, np.uint64), np.array([0]), length)[0]) == 0


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(4)
    texts = dict(enumerate(corpus(rng, 160)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = passages.repeated_passages(df).collect()
    holders = defaultdict(set)
    for i, t in texts.items():
        w = split(t)
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    want = set().union(*(h for h in holders.values() if len(h) > 1))
    got = {r.doc_id for r in rows} | {r.rep_doc_id for r in rows}
    assert len(want - got) <= 0.02 * len(want) and len(want) > 40
    for r in rows:  # and each is one
        a, b = (split(texts[i])[s : s + r.n_words] for i, s in ((r.doc_id, r.start), (r.rep_doc_id, r.rep_start)))
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert len(a) == len(b) == r.n_words >= 50 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_a_shared_line_hides_no_passage(spark):
    rng = random.Random(9)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    line = some(27)
    texts = {i: some(60) + line + some(60) for i in range(150)}
    for i in range(150, 190, 2):  # pairs with a passage of their own around the line, or that line again and again
        own = some(12) + line + some(12) if i % 4 else some(30) + line * 3
        texts[i], texts[i + 1] = some(40) + own + some(50), some(70) + own + some(20)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.rep_doc_id) for r in passages.repeated_passages(df).collect()}
    assert {tuple(sorted(p)) for p in got} >= {(i, i + 1) for i in range(150, 190, 2)}
    assert not any(x < 150 for p in got for x in p)


@pytest.mark.parametrize("edit", ["insert", "delete", "replace"])
def test_passages_with_words_inserted_deleted_or_replaced(spark, edit):
    rng = random.Random(13)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    for n in (55, 60, 80, 98, 140):
        for _ in range(20):
            p = some(n)
            k, size = (rng.randint(n // 2 - 3, n // 2 + 3), 1) if n < 80 or edit != "replace" else (n // 2 - 2, 4)
            q = p[:k] + (some(size) if edit != "delete" else []) + p[k + (0 if edit == "insert" else size) :]
            before, after, skip = some(rng.randint(0, 30)), some(rng.randint(0, 30)), rng.randint(0, 20)
            number = lambda w: np.array([int(x[1:]) for x in w], np.uint64)
            found = passages.alike(number(before + p + after), number(some(skip) + q + some(20)), skip - len(before) + rng.choice([0, len(q) - len(p)]))
            x, y = shingle_set(" ".join(p)), shingle_set(" ".join(q))
            assert (len(before), n, skip, len(q)) in [f[:4] for f in found], (edit, n)
            assert abs(next(f[4] for f in found if f[1] == n) - len(x & y) / len(x | y)) < 1e-9
    texts = {}
    for i in range(0, 120, 2):
        p = some(90)
        q = {"insert": p[:45] + some(1) + p[45:], "delete": p[:45] + p[46:], "replace": p[:43] + some(4) + p[47:]}[edit]
        texts[i], texts[i + 1] = some(40) + p + some(50), some(70) + q + some(20)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    rows = passages.repeated_passages(df).collect()
    got = {tuple(sorted((r.doc_id, r.rep_doc_id))) for r in rows}
    assert got <= {(i, i + 1) for i in range(0, 120, 2)} and len(got) >= 50
    for r in rows:
        x, y = (shingle_set(" ".join(texts[i][s : s + n])) for i, s, n in ((r.doc_id, r.start, r.n_words), (r.rep_doc_id, r.rep_start, r.rep_n_words)))
        assert min(r.n_words, r.rep_n_words) >= 50 and r.similarity >= 0.8 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9


def test_passages_odd_rows(odd, empty):
    got = passages.repeated_passages(odd).collect()
    assert {(r.doc_id, r.rep_doc_id) for r in got} - {(1, 6), (6, 1)} == {(8, 8)}  # a line that repeats within its text
    assert max(r.n_words for r in got if r.doc_id != 8) == 119
    assert passages.repeated_passages(empty).collect() == []


def test_runs_are_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    keys = sorted(rng.randrange(40) for _ in range(500))
    batches, at = [], 0
    while at < len(keys):
        n = rng.choice([0, 1, 2, 7, 30])
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, min(at + n, 500)))], ["k", "v"]))
        at += n
    tables = list(W.runs(batches, ["k"]))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(500))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(keys))


def links(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        root[find(r.doc_id)] = find(r.rep_doc_id)
    return find


def test_no_equal_passage_is_lost_where_texts_share_lines_and_tokens(spark):
    """Texts made of a few lines of 3 to 49 words, so that what stands for a token seldom has the passage around it."""
    rng = random.Random(21)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    lines = [some(rng.choice([3, 8, 20, 30, 45, 49])) for _ in range(25)]
    texts = {}
    for i in range(200):
        w = []
        while len(w) < 250:
            w += rng.choice(lines) if rng.random() < 0.7 else some(rng.randrange(1, 12))
        texts[i] = w
    texts[200], texts[201] = lines[3] * 40, some(20) + lines[3] * 60 + some(30)
    holders, places = defaultdict(set), defaultdict(list)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
            places[i, tuple(w[k : k + 50])].append(k)
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4), part=16).collect()
    find = links(rows)
    shared = [h for h in holders.values() if len(h) > 1]
    assert len(shared) > 1000 and all(len({find(i) for i in h}) == 1 for h in shared)
    within = {i for (i, _), at in places.items() if at[-1] - at[0] >= 50}
    assert within <= {r.doc_id for r in rows} | {r.rep_doc_id for r in rows}
    for r in rows:
        x, y = (shingle_set(" ".join(texts[i][s : s + n])) for i, s, n in ((r.doc_id, r.start, r.n_words), (r.rep_doc_id, r.rep_start, r.rep_n_words)))
        assert min(r.n_words, r.rep_n_words) >= 50 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_recall_of_alike_passages(spark):
    """Of passages with a shingle similarity of 0.8 or more, nine of ten are found in each class of edits."""
    rng = random.Random(31)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts, pairs = {}, defaultdict(list)
    while min(map(len, pairs.values()), default=0) < 150 or len(pairs) < 4:
        kind, p = rng.choice(["substitute", "insert", "delete", "mixed"]), some(rng.randrange(56, 200))
        q = list(p)
        for _ in range(rng.randrange(1, 8)):
            k, how = rng.randrange(len(q)), kind if kind != "mixed" else rng.choice(["substitute", "insert", "delete"])
            q[k : k + (how != "insert")] = some(1) if how != "delete" else []
        x, y = shingle_set(" ".join(p)), shingle_set(" ".join(q))
        if 0.8 <= len(x & y) / len(x | y) < 1 and len(q) >= 50:
            i = len(texts)
            texts[i], texts[i + 1] = some(rng.randrange(40)) + p + some(rng.randrange(40)), some(rng.randrange(40)) + q + some(rng.randrange(40))
            pairs[kind].append(i)
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)).collect()
    got = {min(r.doc_id, r.rep_doc_id) for r in rows if abs(r.doc_id - r.rep_doc_id) == 1}
    recall = {k: sum(i in got for i in v) / len(v) for k, v in pairs.items()}
    assert min(recall.values()) >= 0.9, recall
    print(recall)


def test_no_alike_passage_is_lost_to_chance_or_to_a_shared_line(spark):
    """Passages alike at just over 0.8, some around a line that 150 other texts have and that ends where they differ."""
    rng = random.Random(77)
    some = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    line = some(27)
    texts = {i: some(40) + line + some(40) for i in range(150)}
    for i in range(150, 390, 2):
        own = some(22) if i % 4 else some(100)
        for k in (i, i + 1):
            if i % 4:  # 22 words, another one, the line
                passage = own + some(1) + line
            else:  # two words of a hundred
                passage = own[:33] + some(1) + own[34:67] + some(1) + own[68:]
            texts[k] = some(rng.randrange(40)) + passage + some(rng.randrange(40))
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4), part=16).collect()
    assert {tuple(sorted((r.doc_id, r.rep_doc_id))) for r in rows} == {(i, i + 1) for i in range(150, 390, 2)}


def test_a_seed_is_in_every_alike_pair():
    rng = random.Random(3)
    assert passages.seed(50, 0.8) == 25 and passages.seed(50, 1.0) == 50
    for _ in range(4000):
        p = [rng.randrange(10**9) for _ in range(rng.randrange(50, 260))]
        q = list(p)
        for _ in range(rng.randrange(1, 9)):
            k, how = rng.randrange(len(q)), rng.choice("sid")
            q[k : k + (how != "i")] = [] if how == "d" else [rng.randrange(10**9)]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (p, q))
        if len(q) >= 50 and len(x & y) >= 0.8 * len(x | y):
            runs = {tuple(q[i : i + 25]) for i in range(len(q) - 24)}
            assert any(tuple(p[i : i + 25]) in runs for i in range(len(p) - 24))


def test_a_word_said_again_and_again_has_few_places(spark):
    run = ["again"] * 300
    texts = {i: [f"a{i}x{k}" for k in range(30)] + run[: 300 - 60 * i] + [f"b{i}x{k}" for k in range(30)] for i in range(3)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "row long, text string")
    key = passages._windows(df, 18, 50).groupBy("row", "key").count().agg({"count": "max"}).first()[0]
    assert key <= 3  # first and last, and the place that is compared within the run
    rows = passages.repeated_passages(df.withColumnRenamed("row", "doc_id")).collect()
    assert {(r.doc_id, r.rep_doc_id) for r in rows} >= {(0, 0), (1, 1), (2, 2)} and len({links(rows)(i) for i in texts}) == 1
