"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its five-word shingles. Documents of equal sets form a class; only classes are compared, so
copies, however many, cost one. A class has ``HASHES`` MinHash values of 16 bits, four of which make a band; classes that
agree in a band meet in its bucket, and a pair is looked at in the first band that it agrees in, once. Its values are then
compared a few at a time: with m of n equal and a uniform prior, the similarity s has the posterior Beta(m + 1, n - m + 1),
and the pair is dropped once P(s >= threshold) < ``TOLERANCE``. A pair at the threshold misses all 24 bands with
probability 3e-6.

What survives joins classes into components of candidates. Each class's shingles are sent there once, and the pairs that
survive the same pruning are verified on whole sets. Buckets and components of over ``BLOCK`` classes are cut into blocks
and the pairs of blocks dealt over tasks, so no task holds an unbounded group; within a task, pairs stay in numpy and only
sums and spanning edges, linear in the classes, leave it.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.components import Forest, components
from tessera.llm.scratch import written

THRESHOLD, TOLERANCE, HASHES, ROWS, BLOCK = 0.8, 1e-6, 96, 4, 512
STEPS = (16, 32, 64, 96)
#: Shingles (8 bytes each) in a block of classes that are verified together.
BLOCK_SHINGLES = 1 << 20
_OTHER = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of the sets, uint16 (sets, HASHES); no set may be empty."""
    a, b = _seeds()
    out = np.empty((len(bounds) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = W.mix(np.minimum.reduceat(shingles * a[k] + b[k], bounds[:-1])) & np.uint64(0xFFFF)
    return out


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each of ``STEPS``, the fewest equal values with which P(similarity >= threshold) is not below the tolerance."""
    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return tuple(next(m for m in range(n + 1) if posterior(m, n) >= tolerance) for n in STEPS)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Of pairs of signatures, the places of those that no step drops."""
    left, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in zip(STEPS, least_matches(threshold, tolerance), strict=True):
        matches = matches + (a[left, seen:n] == b[left, seen:n]).sum(1)
        keep = matches >= least
        left, matches, seen = left[keep], matches[keep], n
    return left


def run_pairs(run: np.ndarray, block: np.ndarray, mixed: np.ndarray):
    """Index pairs (i, j) of rows in the same run: of different blocks where ``mixed``, else all. In portions of bounded size."""
    sizes = np.bincount(run)
    size_of = sizes[run]
    for d in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(size_of[:-d] > d) if d < len(run) else np.empty(0, np.int64)
        i = i[run[i] == run[i + d]]
        i = i[~mixed[i] | (block[i] != block[i + d])]
        if len(i):
            yield i, i + d


def _units(rows: DataFrame, blocks: str, node: str) -> DataFrame:
    """``rows`` with the pairs of blocks (bi, bj) that each takes part in; ``blocks``: into how many its group is cut."""
    rows = rows.withColumn("nb", F.col(blocks).cast("int")).withColumn("block", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))
    unit = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj")))
    return rows.withColumn("unit", F.explode(unit)).select("*", "unit.bi", "unit.bj").drop("unit", "nb", blocks)


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def sketches(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """id, key (a text form of the id that is never null), n (shingles), s1, s2 (a hash of the set), sig. All are 0 or empty for a document without a word."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, bounds = W.word_hashes(part.column("text").to_pylist())
                shingles, ends = W.shingles(words, bounds)
                full = np.flatnonzero(np.diff(ends))
                size, s1, s2 = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                sig = [b""] * part.num_rows
                if len(full):
                    sets = [np.unique(shingles[ends[i] : ends[i + 1]]) for i in full.tolist()]
                    size[full] = [len(x) for x in sets]
                    flat, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(size[full])))
                    s1[full] = np.add.reduceat(W.mix(flat), at[:-1]).view(np.int64)
                    s2[full] = np.add.reduceat(W.mix(flat ^ _OTHER), at[:-1]).view(np.int64)
                    for i, x in zip(full.tolist(), signatures(flat, at), strict=True):
                        sig[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(size), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary())], ["id", "key", "n", "s1", "s2", "sig"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), _key(id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, key string, n long, s1 long, s2 long, sig binary")


def _key(id: str, text: str):
    return F.coalesce(F.col(id).cast("string"), F.concat(F.lit("null:"), F.xxhash64(text).cast("string")))


def _candidates(classes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs of classes that agree in a band and survive the pruning."""
    bands = HASHES // ROWS
    hex_ = lambda i: F.conv(F.hex(F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS)), 16, -10).cast("long")
    rows = classes.select("node", F.posexplode(F.array(*(hex_(i) for i in range(bands)))).alias("band", "value"))
    met = rows.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1").select("band", "value", F.ceil(F.col("size") / F.lit(block)).alias("blocks"))
    rows = rows.join(met, ["band", "value"]).join(classes.select("node", "sig"), "node")
    rows = _units(rows, "blocks", "node").select("band", "value", "bi", "bj", "block", "node", "sig")
    keys = ["band", "value", "bi", "bj"]

    def run(batches):
        for t in W.runs(batches, keys):
            columns = {c: t.column(c).to_numpy() for c in (*keys, "block", "node")}
            change = np.zeros(t.num_rows, bool)
            for c in keys:
                change[1:] |= columns[c][1:] != columns[c][:-1]
            sig = _matrix(t.column("sig"), np.uint16, HASHES)
            wide, found = sig.view(np.int64), Forest(t.num_rows)
            for i, j in run_pairs(np.cumsum(change), columns["block"], columns["bi"] != columns["bj"]):
                first = (wide[i] == wide[j]).argmax(1) == columns["band"][i]
                i, j = i[first], j[first]
                keep = survivors(sig[i], sig[j], threshold, tolerance)
                found.add(i[keep], j[keep])
            member, root = found.edges()
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(columns["node"][member]), pa.array(columns["node"][root])], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by products of 0/1 matrices over the elements that at least two hold."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    element, n = np.unique(np.concatenate(sets), return_counts=True)
    element = element[n > 1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.searchsorted(element, np.concatenate(sets))
    held = place < len(element)
    held[held] = element[place[held]] == np.concatenate(sets)[held]
    owner, place = owner[held], place[held]
    width = max(1, min(len(element), (1 << 23) // len(sets)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, len(element), width):
        a, b = np.searchsorted(place, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        out += m @ m.T
    return out


def _verified(docs: DataFrame, classes: DataFrame, grouped: DataFrame, threshold: float, tolerance: float, block: int, id: str, text: str) -> DataFrame:
    """Rows (node, other, links): spanning edges of verified links (links null), and for each class the documents that a pair of blocks links it to (other null)."""
    members = grouped.join(classes.select("node", "key", "copies", "n", "s1", "s2", "sig"), "node")
    # a block has a bounded number of classes and, but for what one very long text has, of shingles
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks")
    members = members.join(members.groupBy("component").agg(blocks), "component")
    rows = docs.select(_key(id, text).alias("key"), F.col(text).alias("text")).join(members, "key")
    names = ["component", "blocks", "node", "copies", "sig"]

    def sets(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, bounds = W.word_hashes(part.column("text").to_pylist())
                shingles, ends = W.shingles(words, bounds)
                keep, out = [], []
                for i, (a, b) in enumerate(zip(part.column("s1").to_pylist(), part.column("s2").to_pylist(), strict=True)):
                    own = np.unique(shingles[ends[i] : ends[i + 1]])  # another row of the same id may have another text
                    if (int(W.mix(own).sum(dtype=np.uint64).astype(np.int64)), int(W.mix(own ^ _OTHER).sum(dtype=np.uint64).astype(np.int64))) == (a, b):
                        keep.append(i)
                        out.append(own.tobytes())
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names), pa.array(out, pa.binary())], [*names, "shingles"])

    rows = rows.mapInArrow(sets, "component long, blocks long, node long, copies long, sig binary, shingles binary")
    keys = ["component", "bi", "bj"]
    rows = _units(rows, "blocks", "node").select(*keys, "block", "node", "copies", "sig", "shingles")

    def run(batches):
        for t in W.runs(batches, keys):
            own = {c: t.column(c).to_numpy() for c in (*keys, "block", "node", "copies")}
            same = np.ones(t.num_rows, bool)
            same[0] = False
            for c in (*keys, "node"):
                same[1:] &= own[c][1:] == own[c][:-1]
            if same.any():  # rows of one id and text were in the documents more than once
                t, own = t.filter(pa.array(~same)), {c: v[~same] for c, v in own.items()}
            change = np.zeros(t.num_rows, bool)
            for c in keys:
                change[1:] |= own[c][1:] != own[c][:-1]
            which, copies, node = np.cumsum(change), own["copies"], own["node"]
            sig = _matrix(t.column("sig"), np.uint16, HASHES)
            shingles = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            size = np.array([len(x) for x in shingles])
            first = np.concatenate(([0], np.flatnonzero(change), [t.num_rows]))
            counts: dict[int, np.ndarray] = {}
            links, found = np.zeros(t.num_rows, np.int64), Forest(t.num_rows)
            for i, j in run_pairs(which, own["block"], own["bi"] != own["bj"]):
                keep = survivors(sig[i], sig[j], threshold, tolerance)
                i, j = i[keep], j[keep]
                both = np.empty(len(i), np.int64)
                for r in np.unique(which[i]).tolist():
                    at = np.flatnonzero(which[i] == r)
                    low, high = first[r], first[r + 1]
                    if high - low < 8:
                        both[at] = [len(np.intersect1d(shingles[x], shingles[y], True)) for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True)]
                        continue
                    if r not in counts:
                        counts[r] = shared_counts(shingles[low:high])
                    both[at] = counts[r][i[at] - low, j[at] - low]
                true = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[true], j[true]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                found.add(i, j)
            some, (member, root) = np.flatnonzero(links), found.edges()
            if len(some):
                other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root])])
                weight = pa.concat_arrays([pa.array(links[some]), pa.nulls(len(member), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[some], node[member]))), other, weight], ["node", "other", "links"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node long, other long, links long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id``, class_id, links, copies, n_shingles.

    links counts the other documents with Jaccard similarity of at least ``threshold``, copies (documents of an equal set,
    itself too) among them; class_id is the smallest id of the documents that links connect, itself where there are none.
    A null or wordless text has n_shingles 0, no links, copies 1 and class_id its own id. A text of one to four words has
    one shingle of all its words. Repeated rows count as copies and give a row each; rows of a null id are linked as
    others (class_id null only if all ids of the class are). An empty table gives an empty table; other columns are not read.
    """
    all_ = written(sketches(docs, id=id, text=text), "sketches")
    full = all_.where("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = _candidates(classes, threshold, tolerance, block)
    grouped = components(edges)
    found = written(_verified(docs, classes, grouped, threshold, tolerance, block, id, text), "links")
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    info = classes.select("n", "s1", "s2", "node", "rep", "copies").join(links, "node", "left").join(linked, "node", "left")
    info = info.withColumn("component", F.coalesce("component", "node"))
    named = info.groupBy("component").agg(F.min("rep").alias("class_id"))
    info = info.join(named, "component").select("n", "s1", "s2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies")
    have = full.select("id", "n", "s1", "s2").join(info, ["n", "s1", "s2"]).select("id", "class_id", "links", "copies", F.col("n").alias("n_shingles"))
    bare = all_.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(1).cast("long").alias("copies"), F.col("n").alias("n_shingles"))
    return have.unionByName(bare).withColumnRenamed("id", id)
