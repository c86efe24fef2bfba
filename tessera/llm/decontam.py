"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` words: its 1s are compared, its 0s ignored, so a hit survives substituted words at
the ignored places. The hashes of all benchmark windows under each mask are joined with those of all text windows. Around
every hit the two are aligned without gaps and the stretch with the best score (+1 for an equal word, ``-MISMATCH`` for a
substituted one) is taken; it counts as a leak when it has ``MIN_MATCHES`` equal words or ``MIN_SHARE`` of the item's
words, and at least ``LEAST``.

No leak is without a hit. The best stretch has a score above 0 from its first word to any other, so its k-th substituted
word is its (3 k + 1)th word at the earliest: of its first 9 words, which ``LEAST`` says it has, two at most are substituted,
the first no earlier than the 4th and the second no earlier than the 7th. There is a mask for each such pair.

An item of fewer than ``LEAST`` words is a leak where all its words stand in a row: its one hash is of the whole item.

The benchmark's hashes are counted first. Up to ``MOST_BROADCAST`` of them are broadcast as sorted arrays with the items'
words, and each task probes its own texts without a shuffle; beyond it the same hashes are joined by a shuffle.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W

SPAN = 9
#: The masks: all places but two at which a leak's first words may be substituted.
MASKS = tuple("".join("0" if k in (i, j) else "1" for k in range(SPAN)) for j in range(6, SPAN) for i in range(3, j))
MISMATCH, MIN_MATCHES, MIN_SHARE, LEAST = 2, 20, 0.6, 9
MOST_BROADCAST = 4_000_000


def seed_hashes(words: np.ndarray, bounds: np.ndarray, masks=MASKS):
    """For each mask, the hashes at every window of ``SPAN`` words within a text, and the windows' first words."""
    counts = np.maximum(np.diff(bounds) - SPAN + 1, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1], counts) + np.repeat(bounds[:-1], counts)
    for k, mask in enumerate(masks):
        total = np.full(max(0, len(words) - SPAN + 1), k + 1, np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                total = (total + words[i : i + len(total)]) * np.uint64(0xD6E8FEB86659FD93)
        yield W.mix(total[at]), at


def whole_hashes(words: np.ndarray, bounds: np.ndarray, n: int):
    """The hashes of all runs of ``n`` words within a text, and their first words: for items of ``n`` words, too few for a seed."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1], counts) + np.repeat(bounds[:-1], counts)
    total = np.full(max(0, len(words) - n + 1), 1000 + n, np.uint64)
    for i in range(n):
        total = (total + words[i : i + len(total)]) * np.uint64(0xD6E8FEB86659FD93)
    return W.mix(total[at]), at


def best_overlap(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int) -> tuple[int, int, int]:
    """Start in ``a``, length and equal words of the best ungapped stretch on the diagonal through (at_a, at_b)."""
    back = min(at_a, at_b)
    i, j = at_a - back, at_b - back
    n = min(len(a) - i, len(b) - j)
    same = a[i : i + n] == b[j : j + n]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return i + start, end - start, int(same[start:end].sum())


_WORKER: dict[str, Probe] = {}


def worker_probe(name: str, items) -> Probe:
    """The worker's tables of a broadcast benchmark, by a name of its own; they outlive a task."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Probe(items.value)
    return _WORKER[name]


class Probe:
    """The benchmark's hashes and words in one worker."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, np.frombuffer(w, np.uint64)) for i, w in items]
        bounds = np.concatenate(([0], np.cumsum([len(w) for _, w in self.items]))).astype(np.int64)
        words = np.concatenate([w for _, w in self.items] + [np.empty(0, np.uint64)])
        self.hashes, self.place = [], []
        sizes = np.diff(bounds)
        self.short = sorted(set(sizes[sizes < LEAST].tolist()) - {0})
        for n, (h, at) in [(0, x) for x in seed_hashes(words, bounds)] + [(n, whole_hashes(words, bounds, n)) for n in self.short]:
            which = np.searchsorted(bounds, at, "right") - 1
            own = sizes[which] == n if n else sizes[which] >= LEAST
            h, at, which = h[own], at[own], which[own]
            order = np.argsort(h, kind="stable")
            self.hashes.append(h[order])
            self.place.append(np.stack((which, at - bounds[which]), 1)[order])
        # a bit table that most windows fail at: 16 slots for each hash at least
        self.bits = max(16, int(np.ceil(np.log2(16 * max(1, sum(map(len, self.hashes)))))))
        self.seen = np.zeros(1 << self.bits, bool)
        for h in self.hashes:
            self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def leaks(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """By (text, item index) the best overlap: equal words, start, length, start in the item."""
        diagonals = set()
        for k, (h, at) in enumerate(chain(seed_hashes(words, bounds), (whole_hashes(words, bounds, n) for n in self.short))):
            own = self.hashes[k]
            if not len(own):
                continue
            maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            if not len(maybe):
                continue
            low, high = np.searchsorted(own, h[maybe], "left"), np.searchsorted(own, h[maybe], "right")
            found = high > low
            for x, a, b in zip(at[maybe[found]].tolist(), low[found].tolist(), high[found].tolist(), strict=True):
                doc = int(np.searchsorted(bounds, x, "right")) - 1
                for item, place in self.place[k][a:b].tolist():
                    diagonals.add((doc, item, x - int(bounds[doc]) - place))
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for doc, item, shift in sorted(diagonals):
            b = self.items[item][1]
            got = verdict(words[bounds[doc] : bounds[doc + 1]], b, shift)
            if got and (doc, item) not in out or got and got > out[doc, item]:
                out[doc, item] = got
        return out


def verdict(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(equal words, start in a, length, start in b) if the diagonal a = b + shift has a leak."""
    if len(b) < LEAST:
        whole = 0 <= shift <= len(a) - len(b) and (a[shift : shift + len(b)] == b).all()
        return (len(b), shift, len(b), 0) if whole else None
    start, length, matches = best_overlap(a, b, max(shift, 0), max(-shift, 0))
    if matches >= LEAST and (matches >= MIN_MATCHES or matches >= MIN_SHARE * len(b)):
        return matches, start, length, start - shift
    return None


RESULT = "item_id long, doc_start long, item_start long, length long, matches long, item_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document and benchmark item that overlap: ``id``, item_id, doc_start, item_start, length, matches, item_words.

    Positions and lengths are in words; of several overlaps of a pair the one with most equal words is given (ties: the
    later start). Null or empty texts and items match nothing; an item of fewer than ``LEAST`` words matches where all of
    them stand in a row. Repeated documents give a row each, repeated items too. Empty tables give an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()

    def as_words(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, bounds = W.word_hashes(part.column("text").to_pylist())
                cut = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(cut, pa.binary())], ["item", "words"])

    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).mapInArrow(as_words, "item long, words binary").where(F.length("words") > 0)
    size = items.agg(F.sum(F.length("words") / 8).alias("n")).first()["n"] or 0
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    if size * len(MASKS) <= most_broadcast:
        name, probe = uuid.uuid4().hex, spark.sparkContext.broadcast(sorted((r["item"], bytes(r["words"])) for r in items.collect()))

        def search(batches):
            own = worker_probe(name, probe)
            for batch in batches:
                for part in W.slices(batch, "text"):
                    found = sorted(own.leaks(*W.word_hashes(part.column("text").to_pylist())).items())
                    ids = part.column("id").take(pa.array([k[0] for k, _ in found], pa.int64()))
                    columns = [[own.items[k[1]][0], v[1], v[3], v[2], v[0], len(own.items[k[1]][1])] for k, v in found]
                    arrays = [pa.array([c[j] for c in columns], pa.int64()) for j in range(6)]
                    yield pa.RecordBatch.from_arrays([ids, *arrays], ["id", "item_id", "doc_start", "item_start", "length", "matches", "item_words"])

        return rows.mapInArrow(search, f"id {kind}, {RESULT}").withColumnRenamed("id", id)
    return _by_shuffle(rows, items, kind).withColumnRenamed("id", id)


def _by_shuffle(rows: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """The same for a benchmark of any size: seed hashes joined by a shuffle, then both sides' words by their ids.

    A seed that many texts or items have is met as often as there are pairs of a text and an item with it, each a leak to be
    judged; Spark splits it by skew. Of a text, a pair carries only the words that the item may meet.
    """

    def seeds(short, item):
        def run(batches):
            for batch in batches:
                for row, raw in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    words = np.frombuffer(raw, np.uint64)
                    bounds, few = np.array([0, len(words)]), item and len(words) < LEAST
                    found = [] if few else list(seed_hashes(words, bounds))
                    found += [whole_hashes(words, bounds, n) for n in short if not item or n == len(words)]
                    for h, at in found:
                        if len(h):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row), pa.int64()), pa.array(h.view(np.int64)), pa.array(at, pa.int64())], ["row", "h", "at"])

        return run

    def as_words(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, bounds = W.word_hashes(part.column("text").to_pylist())
                cut = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(cut, pa.binary())], ["row", "id", "words"])

    from tessera.llm.scratch import written

    texts = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(as_words, f"row long, id {kind}, words binary"), "decontam-texts")
    bench = written(items.withColumn("row", F.monotonically_increasing_id()).select("row", "item", "words"), "decontam-items")
    n_words = (F.length("words") / 8).cast("long")
    short = sorted(r["n"] for r in bench.select(n_words.alias("n")).where(F.col("n") < LEAST).distinct().collect())  # eight at most
    a = texts.select("row", "words").mapInArrow(seeds(short, False), "row long, h long, at long")
    b = bench.select("row", "words").mapInArrow(seeds(short, True), "row long, h long, at long").select(F.col("row").alias("b_row"), "h", F.col("at").alias("b_at"))
    pairs = a.join(b, "h").select("row", "b_row", (F.col("at") - F.col("b_at")).alias("shift")).distinct()
    pairs = pairs.join(bench.select(F.col("row").alias("b_row"), n_words.alias("n")), "b_row")
    first = F.greatest("shift", F.lit(0))
    part = F.substring("words", (first * 8 + 1).cast("int"), ((F.col("shift") + F.col("n") - first) * 8).cast("int"))
    met = pairs.join(texts, "row").select("row", "b_row", "id", first.alias("first"), (F.col("shift") - first).alias("shift"), part.alias("words"))
    full = met.join(bench.select(F.col("row").alias("b_row"), "item", F.col("words").alias("b_words")), "b_row")

    def judge(batches):
        for batch in batches:
            found = []
            for i, (x, y, s, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "b_words", "shift", "first")), strict=True)):
                b = np.frombuffer(y, np.uint64)
                if got := verdict(np.frombuffer(x, np.uint64), b, s):
                    found.append((i, first + got[1], got[3], got[2], got[0], len(b)))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("row", "b_row", "id", "item")] + [pa.array([f[j] for f in found], pa.int64()) for j in range(1, 6)], ["row", "b_row", "id", "item_id", "doc_start", "item_start", "length", "matches", "item_words"])

    judged = full.mapInArrow(judge, f"row long, b_row long, id {kind}, {RESULT}")
    best = judged.groupBy("row", "b_row", "id", "item_id").agg(F.max(F.struct("matches", "doc_start", "length", "item_start", "item_words")).alias("x"))
    return best.select("id", "item_id", "x.doc_start", "x.item_start", "x.length", "x.matches", "x.item_words")
