"""Substring dedup by compact windows.

The tokens of a text are its runs of ``TOKEN`` words. For a hash function, a compact window (c, l, r) says that the token at
c has the smallest value from l to r and not beyond: every stretch within [l, r] that holds c has the same min-hash. The
windows are the nodes of the Cartesian tree of a text's values; those of fewer tokens than a ``seed`` has hold no stretch
that long and are left out, which leaves about one for nine words. They are found without a tree walk: minima of sliding
stretches name the centres, and doubling tables of minima give each one's l and r, for many texts at once.

Two stretches of at least ``WORDS`` words whose five-word shingles have a Jaccard similarity of ``THRESHOLD`` differ in few
places, so they have a run of ``seed`` equal words (25 of 50 at 0.8), and windows with the token of least value in it: one
function is enough, and nothing depends on chance. Windows are joined on the token with one of the group, the first in the
order of a hash of id and text, so a token that a third of all texts share costs one pair a text. Words around the
token meet there and are compared over all shifts: the maximal stretches of at least ``WORDS`` words whose shingles have a
Jaccard similarity of ``THRESHOLD`` are the result. Their lengths may differ.

The first of a group may have the token only, and not the passage that others share. So every other one says where its words
leave the first's, to the right and to the left of the token, and those that leave with the same words make a group
of the next round, with more words in common and a first of their own. Rounds go on until no group has two places, or all
of a group were found alike the text that they left, which links them. No
passage of equal words is lost this way: while neither of two places that share one is the first, they leave the first
together, or not at all within the passage, and then both are alike it. Two places that are alike, but not equal, may both
have the whole run that they share in common with a first that neither is alike. So a place that has a seed in common with
the first, and no passage, also makes groups with each other place of the token that has what they lack in common near it
(``beyond``). Work stays linear: a place is in two groups at most for each that it was in, and in those shingles' once.

A text that stands for over ``PART`` places is dealt to several tasks, each with a copy of its words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.scratch import dropped, released, written

WORDS, SHINGLE, THRESHOLD, PART = 50, 5, 0.8, 512
LENGTH = WORDS - SHINGLE + 1
#: Words of a token. The fewer, the more texts share one by chance; the more, the more windows hold a seed.
TOKEN = 8
#: Places of a run of one word from one that is looked at to the next; a window tells twice that at most. The kind of a window that is compared within its run.
REACH, _WITHIN = 1 << 15, 3
#: Marks of a place, beside the words known to be equal: found alike, and met by a shingle beyond a common run.
_SETTLED, _BEYOND = 1 << 62, 1 << 61
#: Bytes of a word's hash that are sent and compared: a difference passes for none once in 10^12.
SENT = 5
_BASE = 0x9E3779B97F4A7C15


def seed(words: int = WORDS, threshold: float = THRESHOLD) -> int:
    """Equal words in a row that two alike stretches of at least ``words`` words have, whatever differs between them.

    A word put in, left out or replaced costs four shingles of one side and five of the other at least, unless words repeat
    at once. So p shingles have few such places, and the longest run between them is no shorter than the mean.
    """
    least = words
    for p in range(max(1, words - SHINGLE + 1), 8 * words):
        breaks = int(p * (1 - threshold) / (SHINGLE - 1 + SHINGLE * threshold) + 1e-9)
        least = min(least, -(-(p - (SHINGLE - 1) * breaks) // (breaks + 1)) + SHINGLE - 1)
    return least


def compact_windows(values: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, first and last places (in ``values``) of the compact windows of at least ``length`` values; texts lie between ``bounds``.

    Equal values: the first is the smaller.
    """
    n, texts = len(values), len(bounds) - 1
    if not n:
        return (np.empty(0, np.int64),) * 3
    # a wall, smaller than any value, before and after every text
    wall = bounds + np.arange(texts + 1)
    size = n + texts + 1
    place = np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(bounds))
    bits = np.uint64(max(1, int(size).bit_length()))
    key = np.arange(size, dtype=np.uint64)
    key[place] |= ((values >> bits) | np.uint64(1)) << bits  # the place in the low bits settles ties
    levels = [key]
    longest = int(np.diff(bounds).max()) + 2
    while 1 << len(levels) <= longest:
        step, top = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(top[:-step], top[step:]) if len(top) > step else top[:0])
    low = max(0, length.bit_length() - 1)
    if low >= len(levels) or len(levels[low]) <= length - (1 << low):
        return (np.empty(0, np.int64),) * 3
    table, shift = levels[low], length - (1 << low)
    least = np.minimum(table[: len(table) - shift], table[shift:])
    centre = np.unique((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    is_wall = np.zeros(size, bool)
    is_wall[wall] = True
    centre = centre[~is_wall[centre]]
    own = key[centre]
    left, right = centre.copy(), centre.copy()  # grow while everything taken in is larger
    for level in reversed(range(len(levels))):
        step, table = 1 << level, levels[level]
        if not len(table):
            continue
        at = left - step
        ok = at >= 0
        ok[ok] = table[at[ok]] > own[ok]
        left = np.where(ok, at, left)
        at = right + 1
        ok = at < len(table)
        ok[ok] = table[at[ok]] > own[ok]
        right = np.where(ok, right + step, right)
    wide = right - left + 1 >= length
    text = np.searchsorted(wall, centre[wide], "right")
    return centre[wide] - text, left[wide] - text, right[wide] - text


def _runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        total = (total + words[i : i + len(total)]) * np.uint64(0xD6E8FEB86659FD93 + 2 * i)
    return total


def _alike_runs(x: np.ndarray, y: np.ndarray, shift: int) -> np.ndarray:
    """Runs (i, j, size) of equal values x[i : i + size] and y[j : j + size]: those ``shift`` on, and of each value the k-th in ``x`` with the k-th in ``y``."""
    i = np.arange(max(0, -shift), max(min(len(x), len(y) - shift), max(0, -shift)))
    straight = i[x[i] == y[i + shift]]

    both = np.concatenate((x, y))
    order = np.argsort(both, kind="stable")  # of equal values those of x first
    own, of_x = both[order], order < len(x)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sizes = np.diff(np.append(first, len(own)))
    in_x = np.add.reduceat(of_x, first, dtype=np.int64)
    rank = np.arange(len(own)) - np.repeat(first, sizes) - np.where(of_x, 0, np.repeat(in_x, sizes))
    meets = rank < np.repeat(np.minimum(in_x, sizes - in_x), sizes)
    base = len(x) + len(y) + 1
    points = np.sort(np.concatenate((straight * base + straight + shift, order[meets & of_x] * base + order[meets & ~of_x] - len(x))))
    points = points[np.concatenate(([True], points[1:] != points[:-1]))[: len(points)]]
    i, j = points // base, points % base
    order = np.argsort((j - i + len(x)) * base + i, kind="stable")
    i, j = i[order], j[order]
    if not len(i):
        return np.empty((0, 3), np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1))))
    runs = np.column_stack((i[first], j[first], np.diff(np.append(first, len(i)))))
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _stretches(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, size: int, threshold: float, n: int = SHINGLE):
    """Of a chain of equal runs (i, j, w) of the shingles x and y: from each first run the furthest last one at which ``threshold`` is reached, if none before reached as far."""
    total, reached = np.cumsum(w), -1
    for p in range(len(i)):
        if reached == len(i) - 1:
            return
        c = total[p:] - total[p] + w[p]
        p_size, q_size = i[p:] + w[p:] - i[p], j[p:] + w[p:] - j[p]
        good = np.flatnonzero((c >= (threshold - 1e-9) * (p_size + q_size - c)) & (p_size >= size) & (q_size >= size))
        for q in good[::-1].tolist():
            if p + q <= reached:
                break
            s, t, m, k = int(i[p]), int(j[p]), int(p_size[q]), int(q_size[q])
            one, two = set(x[s : s + m].tolist()), set(y[t : t + k].tolist())
            both = len(one & two)
            similarity = both / (len(one) + len(two) - both)
            if similarity >= threshold - 1e-9:
                reached = p + q
                yield s, m + n - 1, t, k + n - 1, similarity
                break


def alike(a: np.ndarray, b: np.ndarray, shift: int, least: int = WORDS, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(start in a, words, start in b, words, similarity) of the alike stretches of two word sequences, where a[i] may meet b[i + shift].

    Equal runs of shingles over all shifts are chained in the order of both sides, the heaviest chain first, then those of
    the runs left, so that words may be inserted, deleted or replaced.
    """
    if min(len(a), len(b)) < least:
        return []
    x, y, size = _runs_of(a, SHINGLE), _runs_of(b, SHINGLE), least - SHINGLE + 1
    runs, out = _alike_runs(x, y, shift), []
    while len(runs) and runs[:, 2].sum() >= threshold * size:
        i, j, w = runs.T
        best, back = w.copy(), np.full(len(runs), -1)
        for q in range(1, len(runs)):
            p = np.flatnonzero((i[:q] + w[:q] <= i[q]) & (j[:q] + w[:q] <= j[q]))
            if len(p):
                top = p[np.argmax(best[p])]
                best[q], back[q] = best[top] + w[q], top
        chain = [int(np.argmax(best))]
        if best[chain[0]] < threshold * size:
            break
        while back[chain[-1]] >= 0:
            chain.append(int(back[chain[-1]]))
        chain = np.array(chain[::-1])
        out += _stretches(x, y, i[chain], j[chain], w[chain], size, threshold)
        runs = np.delete(runs, chain, 0)
    return out


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 2 ** bits of an odd number and of its inverse, modulo 2 ** 64."""
    n = (1 << bits) + 1
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


class Ranges:
    """Hashes of any stretch of an array, equal for equal stretches wherever they are."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(20, int(len(values)).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """``last`` is the place after the stretch."""
        return W.mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def _ends_of_repeats(words: np.ndarray, bounds: np.ndarray, ends: np.ndarray, least: int, c: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows (c, left, right, text, key, within) without those whose centre is inside a run of one word said again and again.

    A run of n words has a window for nearly each of its n - TOKEN + 1 equal tokens, and each would be compared at a shift
    of its own. The run's first and last place stand for them, both with the window of the first. For let M be the whole
    stretch of equal words that two texts have at a shift, and its least token lie in such a run. If the run begins within M
    in both texts, its first places meet at that shift; if it ends within M in both, its last ones do. Else M is that one
    word, and the two runs, begun together, are as long as M. A run of 2 * ``least`` words repeats itself: the place
    ``least`` words on (within) is to be compared with its first.
    """
    same = np.concatenate((words[1:] == words[:-1], [False]))[: len(words)]
    same[bounds[1:-1][bounds[1:-1] > 0] - 1] = False  # not across texts
    breaks = np.concatenate(([-1], np.flatnonzero(~same)))
    at = bounds[text] + c - ends[text]
    k = np.searchsorted(breaks, at)
    begun, last = at - breaks[k - 1] - 1, breaks[k] - TOKEN + 1 - at  # places since the first, to the last
    keep = (last < 0) | (begun % REACH == 0)
    more, long = keep & (last > 0) & (begun == 0), keep & (last + TOKEN >= 2 * least)
    put = lambda *v: np.concatenate([u[m] for u, m in zip(v, (keep, more, long), strict=True)])
    return put(c, c + last, c + least), *(put(v, v, v) for v in (left, right, text, key)), np.repeat([False, True], [keep.sum() + more.sum(), long.sum()])


def _windows(rows: DataFrame, length: int, words: int) -> DataFrame:
    """Rows (key, row, kind, w) of all compact windows of at least ``length`` tokens; key is the hash of the token.

    kind: 0 for the only window of the row with its key, else 1 for the first and 2 for the others; 3 for one that is to be
    compared with that ``words`` words before it in the same row, and no other. w: the centre, and how
    far the window reaches to the left and right (65535 at most; longer stretches have more windows) in one number. Of
    windows of a row with one key whose words are equal as far as a passage of ``words`` may reach, one is given: lines
    that repeat many times would make many windows that say the same.
    """

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                hashed, bounds = W.word_hashes(part.column("text").to_pylist())
                tokens, ends = W.shingles(hashed, bounds, TOKEN)
                row = part.column("row").to_numpy()
                key = W.mix(tokens ^ np.uint64(_BASE))
                c, left, right = compact_windows(key, ends, length)
                if not len(c):
                    continue
                text, key = np.searchsorted(ends, c, "right") - 1, key[c]
                long = np.diff(bounds)[text] >= words  # shorter texts have no passage
                c, left, right, text, key, within = _ends_of_repeats(hashed, bounds, ends, words, *(v[long] for v in (c, left, right, text, key)))
                whole = [v[within] for v in (c, left, right, text, key)]
                c, left, right, text, key = (v[~within] for v in (c, left, right, text, key))
                order = np.lexsort((c, key, text))
                c, left, right, text, key = c[order], left[order], right[order], text[order], key[order]
                again = np.concatenate(([False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])))
                if again.any():
                    around = Ranges(tokens)
                    low, high = np.maximum(c - 2 * words, ends[text]), np.minimum(c + 2 * words, ends[text + 1])
                    context = W.mix(around(low, high) + (c - low).astype(np.uint64))
                    context = np.where(again | np.append(again[1:], False), context, 0)
                    order = np.lexsort((c, context, key, text))
                    same = (context[order[1:]] == context[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                    keep = np.ones(len(c), bool)
                    keep[order[1:][same]] = False
                    c, left, right, text, key = c[keep], left[keep], right[keep], text[keep], key[keep]
                    again = np.concatenate(([False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])))
                kind = np.concatenate((np.where(again, 2, np.append(again[1:], False)), np.full(len(whole[0]), _WITHIN))).astype(np.int8)
                c, left, right, text, key = map(np.concatenate, zip((c, left, right, text, key), whole, strict=True))
                w = (c - ends[text]) << 32 | np.minimum(c - left, 0xFFFF) << 16 | np.minimum(right - c, 0xFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row[text]), pa.array(kind), pa.array(w)], ["key", "row", "kind", "w"])

    return rows.mapInArrow(run, "key long, row long, kind byte, w long")


def _left(w: str):
    return F.shiftright(w, 16).bitwiseAND(0xFFFF)


def _right(w: str):
    return F.col(w).bitwiseAND(0xFFFF)


def _first_pairs(windows: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (row, w, x, rep, rw): every window with the first of those of the same key, but itself. x: no words known to be equal beyond the token."""
    first = windows.where("kind < 2").groupBy("key").agg(F.min("row").alias("rep"), F.min_by("w", "row").alias("rw"), F.max("row").alias("top"), F.max("kind").alias("kind"))
    # joined as a table, so that Spark can split a token of very many texts
    first = written(first.where("top <> rep or kind = 1").select("key", "rep", "rw"), "shared-tokens")
    # the same plan at every size: windows are met by a shuffle
    met = windows.join(first.hint("merge"), "key", "left").where(f"kind = {_WITHIN} or row <> rep or w <> rw")
    before = F.shiftleft(F.shiftright("w", 32) - words, 32) + F.shiftleft(_left("w") - words, 16) + F.least(_right("w") + words, F.lit(0xFFFF))
    within = F.col("kind") == _WITHIN
    return met.select("row", "w", F.lit(0).cast("long").alias("x"), F.when(within, F.col("row")).otherwise(F.col("rep")).alias("rep"), F.when(within, before).otherwise(F.col("rw")).alias("rw"))


def _next_pairs(left: DataFrame) -> DataFrame:
    """The same of the places (key, row, w, x) that left the first of their group, by the words with which they left. Groups of places that are all alike that first are linked."""
    settled = F.shiftright("x", 62).bitwiseAND(1)
    groups = left.groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min(settled).alias("settled")).where("n > 1 and settled = 0").select("key", "rep")
    met = written(left.withColumn("x", F.col("x").bitwiseAND(_SETTLED - 1)).join(groups, "key"), "places")
    first = met.where("row = rep").groupBy("key").agg(F.min("w").alias("rw"))
    return met.join(first, "key").where("row <> rep or w <> rw").select("row", "w", "x", "rep", "rw").distinct()


def _reach(w: np.ndarray, other: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of a window's text that a passage shared with the other window may have.

    The run of equal words lies in both windows, and the passage goes beyond what they agree on by a third of that, as its
    sides may differ in length, or by ``words``.
    """
    before, after = np.minimum(w >> 16 & 0xFFFF, other >> 16 & 0xFFFF), np.minimum(w & 0xFFFF, other & 0xFFFF)
    more = np.maximum((before + after + 1) // 3 + 1, words)
    return (w >> 32) - before - more, (w >> 32) + after + more


def _packed(words: np.ndarray) -> np.ndarray:
    """The low bytes of each word's hash."""
    return np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].reshape(-1)


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(raw, np.uint8).reshape(-1, SENT)
    return out.view("<u8").reshape(-1)


def _flat(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes cut into values of the given sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def compared(flat: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, shift: np.ndarray, wanted: np.ndarray, group: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, least: int = WORDS, threshold: float = THRESHOLD, within: np.ndarray | None = None):
    """Many pairs of word sequences, cut out of ``flat``, at once.

    Gives the alike stretches as a list of (pair, start in a, words, start in b, words, similarity), for the pairs
    ``wanted``, and for each word of all the a's whether it equals the one ``shift`` on. Pairs whose only equal shingles are
    one run, or too few, are done with for all pairs together; the rest are chained one by one. Pairs of a ``group`` are of
    the same two texts, at the words ``a_first`` and ``b_first``: what lies in a stretch found at one shift is not tried again.
    Pairs ``within`` one text: a stretch with itself is none.
    """
    n, need = len(a), threshold * (least - SHINGLE + 1)
    pair, b_pair = np.repeat(np.arange(n), a_size), np.repeat(np.arange(n), b_size)
    at, b_at = np.concatenate(([0], np.cumsum(a_size))), np.concatenate(([0], np.cumsum(b_size)))
    i, j = np.arange(at[-1]) - at[pair], np.arange(b_at[-1]) - b_at[b_pair]
    x, y = flat[a[pair] + i], flat[b[b_pair] + j]
    other = i + shift[pair]
    inside = (other >= 0) & (other < b_size[pair])
    same = np.zeros(len(x), bool)
    same[inside] = x[inside] == y[(b_at[pair] + other)[inside]]
    whole, b_whole = i <= a_size[pair] - SHINGLE, j <= b_size[b_pair] - SHINGLE  # where a shingle begins
    straight = same.copy()
    for k in range(1, SHINGLE):
        straight[:-k] &= same[k:]
    straight &= whole
    count = np.bincount(pair[straight], minlength=n)
    hope = wanted & (np.minimum(a_size, b_size) >= least)
    rest, all_x, all_y = whole & ~straight & hope[pair], whole & hope[pair], b_whole & hope[b_pair]
    salt = np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    runs = lambda v, p, m: W.mix(np.append(_runs_of(v, SHINGLE), np.zeros(min(len(v), SHINGLE - 1), np.uint64))[m] + salt[p[m]])
    kx, ky = runs(x, pair, all_x), runs(y, b_pair, all_y)
    extra = np.flatnonzero(all_x)[_held(kx, ky, rest[all_x])]  # shingles of a that b has, at another shift
    off = np.bincount(pair[extra], minlength=n)
    shared = straight.copy()
    shared[extra] = True
    # where enough is equal at this shift, what only repeats it elsewhere adds nothing
    again = np.zeros(len(x), bool)
    inside = np.flatnonzero(all_x)
    again[inside[_held(kx, kx[straight[inside]], ~straight[inside])]] = True
    extra = extra[~again[extra] | (count[pair[extra]] < need)]
    off = np.where(count < need, off, np.bincount(pair[extra], minlength=n))
    begin = np.flatnonzero(straight & ~np.concatenate(([False], straight[:-1])))
    end = np.flatnonzero(straight & ~np.concatenate((straight[1:], [False]))) + 1
    pieces = np.bincount(pair[begin], minlength=n)
    # a passage of p shingles has at least 0.8 p of the other's, so 0.6 of some stretch of the least size
    dense = np.concatenate(([0], np.cumsum(shared)))
    span = np.minimum(i + least - SHINGLE + 1, a_size[pair]) + at[pair]
    most = np.maximum.reduceat(np.append(dense[span] - dense[:-1], 0), at[:-1])
    enough = hope & (count + off >= need) & (most >= (2 * threshold - 1) * (least - SHINGLE + 1))
    first = np.zeros(n, np.int64)
    first[pair[begin][::-1]] = i[begin][::-1]
    # whatever else is equal is too little by itself, and too far from what is equal at this shift to belong to it
    near, runs_at = np.full(n, 1 << 40), np.append(np.flatnonzero(straight), 1 << 40)
    k = np.searchsorted(runs_at, extra)
    after, prior = runs_at[k], np.where(k > 0, runs_at[k - 1], -(1 << 40))
    after, prior = np.where(after < at[pair[extra] + 1], after, 1 << 40), np.where(prior >= at[pair[extra]], prior, -(1 << 40))
    np.minimum.at(near, pair[extra], np.minimum(after - extra, extra - prior))
    here = enough & (pieces > 0) & ((off == 0) | (off < need) & (4 * near > count + off))
    simple = here & (pieces == 1)
    good = np.flatnonzero(simple & (count >= least - SHINGLE + 1))
    s, m = first[good], count[good] + SHINGLE - 1
    found = list(zip(good.tolist(), s.tolist(), m.tolist(), (s + shift[good]).tolist(), m.tolist(), [1.0] * len(good), strict=True))
    run_at = np.concatenate(([0], np.cumsum(pieces)))
    seen: dict[int, list] = {}  # of the pairs of one group, what was found over all shifts
    slow = np.flatnonzero(enough & ~simple)
    for k in slow[np.argsort(-a_size[slow], kind="stable")].tolist():
        p, q = x[at[k] : at[k + 1]], y[b_at[k] : b_at[k + 1]]
        r = slice(run_at[k], run_at[k + 1])
        u, w = i[begin[r]], end[r] - begin[r]
        if here[k]:  # a chain as it is
            found += [(k, *f) for f in _stretches(_runs_of(p, SHINGLE), _runs_of(q, SHINGLE), u, u + shift[k], w, least - SHINGLE + 1, threshold)]
            continue
        known = seen.setdefault(int(group[k]), [])
        left, low = int(a_first[k]), int(b_first[k])
        if len(u) and any(f <= left + u[0] and left + u[-1] + w[-1] + SHINGLE - 1 <= f + m and g <= low + u[0] + shift[k] and low + u[-1] + w[-1] + shift[k] + SHINGLE - 1 <= g + o for f, m, g, o in known):
            continue
        new = alike(p, q, int(shift[k]), least, threshold)
        if within is not None and within[k]:
            new = [f for f in new if abs(left + f[0] - low - f[2]) >= least]
        known += [(left + f, m, low + g, o) for f, m, g, o, _ in new]
        found += [(k, *f) for f in new]
    return found, same


def _held(x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places ``asked`` (a mask) of ``x`` whose value is in ``y``: by a table of bits, and exactly for what passes it."""
    places = np.flatnonzero(asked)
    if not len(places) or not len(y):
        return places[:0]
    bits = max(12, int(4 * max(len(y), 1)).bit_length())
    slot = lambda v: (v >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, bool)
    table[slot(y)] = True
    places = places[table[slot(x[places])]]
    if not len(places):
        return places
    table[:] = False
    table[slot(x[places])] = True
    return places[np.isin(x[places], y[table[slot(y)]], kind="sort")]


def beyond(words: np.ndarray, at: np.ndarray, same: np.ndarray, pair: np.ndarray, c: np.ndarray, length: int, need: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the places with a run of ``length`` equal words around their token: for shingles within ``reach`` of the run and not in it, with the token.

    The arguments are those of ``left_behind``. Alike stretches have ``need`` shingles in common. What the run lacks of them
    is near it and mostly in one piece, so of that many shingles in a row (a power of two, 16 at most) the least is taken:
    the shorter run takes fewer, and the longer takes them too. Runs of ``need`` shingles are alike as they are.
    """
    own = at[pair] + c
    differs = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    k = np.searchsorted(differs, own)
    low, high = np.maximum(differs[k - 1] + 1, at[pair]), np.minimum(differs[k], at[pair + 1])
    lacks = need - (high - low - SHINGLE + 1)
    place = np.flatnonzero((low <= own) & (high >= own + TOKEN) & (high - low >= length) & (lacks > 0))
    shingle = W.mix(_runs_of(words, SHINGLE))
    if not len(place):
        return place, np.empty(0, np.uint64)
    own, low, high = own[place], low[place], high[place]
    level = np.minimum(np.floor(np.log2(lacks[place])).astype(np.int64), 4)
    taken = np.zeros((5, len(shingle)), bool)
    taken[0] = True
    for n in range(1, min(5, len(shingle).bit_length())):
        stretches = np.lib.stride_tricks.sliding_window_view(shingle, 1 << n)
        taken[n, np.argmin(stretches, 1) + np.arange(len(stretches))] = True
    first = np.maximum(at[pair[place]], low - reach)
    size = np.clip(np.minimum(at[pair[place] + 1] - SHINGLE + 1, high + reach) - first, 0, None)
    of, j = np.repeat(np.arange(len(place)), size), _flat(first, size)
    ok = taken[level[of], j] & ((j < low[of]) | (j + SHINGLE > high[of]))
    of, j = of[ok], j[ok]
    token = Ranges(words)(own, own + TOKEN)
    key = W.mix(shingle[j] ^ W.mix(token + np.uint64(1))[of] ^ (j > own[of]).astype(np.uint64))
    order = np.lexsort((key, of))  # where words repeat, so do shingles
    of, key = of[order], key[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])))[: len(of)]
    return place[of[new]], key[new]


def left_behind(words: np.ndarray, at: np.ndarray, same: np.ndarray, pair: np.ndarray, c: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where places leave the text that they were compared with: (place, key, x) to the right and to the left.

    ``words``, ``at``, ``same``: of all pairs, as in ``compared``; a place is a window w of the pair whose centre is at c there,
    with as many words known to be equal before and after its token as x says. key: a hash of the words that are equal and
    the first that is not. Beyond the window there is nothing to say: no passage of this token reaches there.
    """
    own = at[pair] + c
    low, high = own - (x >> 32), own + TOKEN - 1 + (x & 0xFFFFFFFF)
    ok = (low >= at[pair]) & (high < at[pair + 1])
    place = np.flatnonzero(ok)
    pair, own, low, high, w, x = pair[ok], own[ok], low[ok], high[ok], w[ok], x[ok]
    differs = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    k = np.searchsorted(differs, low)
    hashed = Ranges(words)
    equal = differs[k] > high
    right = equal & (differs[k] < at[pair + 1]) & (differs[k] - own <= (w & 0xFFFF) + TOKEN - 1)
    left = equal & (differs[k - 1] >= at[pair]) & (own - differs[k - 1] <= (w >> 16 & 0xFFFF))
    d, e = differs[k[right]], differs[k[left] - 1]
    mark = lambda first, last, c: W.mix(hashed(first, last + 1) ^ (c - first).astype(np.uint64))
    keys = np.concatenate((mark(low[right], d, own[right]), mark(e, high[left], own[left])))
    known = np.concatenate((x[right] >> 32 << 32 | d - own[right] - TOKEN + 1, own[left] - e << 32 | x[left] & 0xFFFFFFFF))
    return np.concatenate((place[right], place[left])), keys, known


def _cut(batches, longest: int):
    """Words around the places of each text, for the text that stands for it: sorted rows of a text, then of its places and of what it stands for."""
    before = None  # row, id and words of the text at hand
    for batch in batches:
        for part in W.slices(batch, "text"):
            is_text = pc.is_valid(part.column("text")).to_numpy(zero_copy_only=False)
            row = part.column("row").to_numpy()
            texts = np.flatnonzero(is_text)
            words, bounds = W.word_hashes(part.column("text").take(pa.array(texts)).to_pylist())
            ids = part.column("id").take(pa.array(texts))
            rows = row[texts]
            if before is not None:
                words, bounds = np.concatenate((before[2], words)), np.concatenate(([0], bounds + len(before[2])))
                ids, rows = pa.concat_arrays([before[1], ids]), np.concatenate(([before[0]], rows))
            which = np.cumsum(is_text) - (0 if before is not None else 1)
            need = np.flatnonzero(~is_text & (which >= 0))
            need = need[rows[which[need]] == row[need]]
            if len(rows):
                before = (rows[-1], ids.slice(len(rows) - 1), words[bounds[-2] : bounds[-1]].copy())
            if not len(need):
                continue
            get = lambda c: part.column(c).take(pa.array(need)).to_numpy()  # noqa: B023, E731
            text, rep, place, w, x, rw = which[need], get("rep"), get("part"), get("w"), get("x"), get("rw")
            stands = place < 0
            low, high = _reach(w, rw, longest)
            rep_low, rep_high = _reach(rw, w, longest)
            low, high = np.where(stands, w, low), np.where(stands, rw, high)
            shift = np.where(stands, 0, (rw >> 32) - (w >> 32))
            order = np.lexsort((w, shift, place, rep, text))
            low, high, rep_low, rep_high, text, rep, place, w, x, shift, stands = (v[order] for v in (low, high, rep_low, rep_high, text, rep, place, w, x, shift, stands))
            new = np.ones(len(text), bool)
            new[1:] = stands[1:] | (text[1:] != text[:-1]) | (rep[1:] != rep[:-1]) | (place[1:] != place[:-1]) | (shift[1:] != shift[:-1])
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(text)))
            low, high, rep_low, rep_high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(rep_low, at), np.maximum.reduceat(rep_high, at)
            known, goes_on = np.stack((w, x), 1), ~stands & (x < _BEYOND)
            sizes_sent = np.add.reduceat(goes_on, at, dtype=np.int64)
            # a text that stands for many goes to each of their parts
            parts = np.where(stands[at], -place[at], 1)
            group = np.repeat(np.arange(len(at)), parts)
            copy = np.arange(len(group)) - np.repeat(np.cumsum(parts) - parts, parts)
            text, low, high = text[at][group], np.maximum(low[group], 0), high[group]
            size = np.clip(np.minimum(high + TOKEN, np.diff(bounds)[text]) - low, 0, None)
            where = np.where(stands[at][group], copy, place[at][group])
            begin = 0
            while begin < len(group):
                end = max(begin + 1, int(np.searchsorted(np.cumsum(size[begin:]), 1 << 20, "right")) + begin)
                g, k = group[begin:end], slice(begin, end)
                sent = sizes_sent[g]
                own = _flat(at[g], np.where(stands[at][g], 0, sizes[g]))
                own = own[goes_on[own]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rep[at][g]), pa.array(where[k].astype(np.int32)), pa.array(np.where(stands[at][g], 0, 1).astype(np.int32)), pa.array(rows[text[k]]), ids.take(pa.array(text[k])),
                        pa.array(shift[at][g]), pa.array(low[k]), pa.array(rep_low[g]), pa.array(rep_high[g]),
                        _binary(_packed(words[_flat(bounds[text[k]] + low[k], size[k])]), size[k] * SENT), _binary(known[own].reshape(-1).view(np.uint8), sent * 16),
                    ],
                    ["rep", "part", "other", "row", "id", "shift", "from", "rep_from", "rep_to", "words", "places"],
                )
                begin = end


def _judged(batches, words: int, threshold: float):
    """Of words sorted by the text that stands for others: the alike stretches (key null), and the places that leave it (id null)."""
    names = ["id", "start", "n_words", "rep_id", "rep_start", "rep_n_words", "similarity", "key", "row", "w", "x"]
    length, need = seed(words, threshold), int(np.ceil(2 * threshold / (1 + threshold) * (words - SHINGLE + 1) - 1e-9))
    before = None  # rep, part, id, first word and words of the text that stands for the others
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        rep, place, other, row, shift, first, rep_low, rep_high = (column(c) for c in ("rep", "part", "other", "row", "shift", "from", "rep_from", "rep_to"))
        ids, kind = batch.column("id"), batch.schema.field("id").type
        size = pc.binary_length(batch.column("words")).to_numpy() // SENT
        flat = _unpacked(b"".join(batch.column("words").to_pylist()))
        start = np.cumsum(size) - size
        stands = np.flatnonzero(other == 0)
        s_rep, s_part, s_first, s_start, s_size, s_ids = rep[stands], place[stands], first[stands], start[stands], size[stands], ids.take(pa.array(stands))
        which = np.cumsum(other == 0) - 1
        if before is not None:
            start = start + len(before[4])
            flat = np.concatenate((before[4], flat))
            s_rep, s_part, s_first = (np.concatenate(([v], u)) for v, u in zip(before[:2] + (before[3],), (s_rep, s_part, s_first), strict=True))
            s_start, s_size, s_ids = np.concatenate(([0], s_start + len(before[4]))), np.concatenate(([len(before[4])], s_size)), pa.concat_arrays([before[2], s_ids])
            which = which + 1
        if len(s_rep):
            before = (s_rep[-1], s_part[-1], s_ids.slice(len(s_rep) - 1), s_first[-1], flat[s_start[-1] : s_start[-1] + s_size[-1]].copy())
        pairs = np.flatnonzero((other == 1) & (which >= 0))
        pairs = pairs[(s_rep[which[pairs]] == rep[pairs]) & (s_part[which[pairs]] == place[pairs])]
        known = [np.frombuffer(v, np.int64).reshape(-1, 2) for v in batch.column("places").take(pa.array(pairs)).to_pylist()]
        at, total = 0, np.cumsum(size[pairs] + rep_high[pairs] - rep_low[pairs])
        while at < len(pairs):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
            p = pairs[at:end]
            s = which[p]
            low = np.clip(rep_low[p] - s_first[s], 0, s_size[s])
            b_size = np.clip(rep_high[p] + TOKEN - s_first[s], low, s_size[s]) - low
            rep_first = low + s_first[s]
            within = row[p] == rep[p]
            group = np.cumsum(np.concatenate(([0], (np.diff(row[p]) != 0) | (np.diff(s) != 0))))
            found, same = compared(flat, start[p], size[p], s_start[s] + low, b_size, first[p] + shift[p] - rep_first, ~within | (np.abs(shift[p]) >= words), group, first[p], rep_first, words, threshold, within)
            # of one text: not a stretch with itself
            found = [f for f in found if not within[f[0]] or abs(first[p[f[0]]] + f[1] - rep_first[f[0]] - f[3]) >= words]
            if found:
                k, a, n, b, m, j = (np.array(v) for v in zip(*found, strict=True))
                nothing = [pa.nulls(len(k), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[k])), pa.array(first[p[k]] + a), pa.array(n), s_ids.take(pa.array(s[k])), pa.array(rep_first[k] + b), pa.array(m), pa.array(j), *nothing], names)
            of = np.repeat(np.arange(len(p)), [len(v) for v in known[at:end]])
            w, x = np.concatenate([*known[at:end], np.empty((0, 2), np.int64)]).T
            ends = np.concatenate(([0], np.cumsum(size[p])))
            c, around = (w >> 32) - first[p[of]], flat[_flat(start[p], size[p])]
            # a place in a passage that the same two texts share, at whatever shift, is linked
            settled, by_group = np.zeros(len(w), bool), group[of]
            for f in found:
                here, low = slice(*np.searchsorted(by_group, (group[f[0]], group[f[0]] + 1))), first[p[f[0]]] + f[1]
                settled[here] |= (w[here] >> 32 >= low) & ((w[here] >> 32) + TOKEN <= low + f[2])
            k, key, x = left_behind(around, ends, same, of, c, w, x)
            x = x | np.where(settled[k], _SETTLED, 0)
            free = np.flatnonzero(~settled)
            more, more_key = beyond(around, ends, same, of[free], c[free], length, need, words)
            k, key, x = np.concatenate((k, free[more])), np.concatenate((key, more_key)), np.concatenate((x, np.full(len(more), _BEYOND)))
            if len(k):
                nothing = [pa.nulls(len(k), t) for t in (kind, pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array(key.view(np.int64)), pa.array(row[p[of[k]]]), pa.array(w[k]), pa.array(x)], names)
            at = end


def repeated_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """Pairs of passages that repeat: ``id``, start, n_words, rep_<id>, rep_start, rep_n_words, similarity.

    Each is a stretch of at least ``words`` words of the row's text and one of the text that stands for its group (or, at
    another place, of its own text, if the two do not overlap at that shift); starts count words from 0. Every two places
    that share ``words`` equal words are linked, directly or through the texts that stand for them; so are stretches that are
    alike only, as the module says. Words are compared by 40 bits of a hash. Rows equal in
    id and text count as one. Null, empty and shorter texts have none. Null ids are kept. An empty table gives an empty
    result. Other columns are not read.
    """
    length = seed(words, threshold) - TOKEN + 1
    if length < 1:
        raise ValueError(f"alike passages need to have {TOKEN} equal words in a row: more words or a higher threshold")
    kind = docs.schema[id].dataType.simpleString()
    # a number for each row that a second read gives again
    rows = docs.select(F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    if not rows.groupBy("row").count().where("count > 1").isEmpty():
        rows = written(rows.dropDuplicates(["row"]), "distinct-texts")
    pairs, found, nth = written(_first_pairs(_windows(rows.select("row", "text"), length, words), words), "pairs"), [], 0
    released(docs.sparkSession)
    while nth == 0 or not pairs.isEmpty():
        judged = written(_round(rows, pairs, kind, words, threshold, part, nth), "judged")
        found.append(judged.where("key is null").select("id", "start", "n_words", "rep_id", "rep_start", "rep_n_words", "similarity"))
        last, pairs, nth = pairs, written(_next_pairs(judged.where("key is not null").select("key", "row", "w", "x")), "pairs"), nth + 1
        dropped(last)
        released(docs.sparkSession)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct().withColumnsRenamed({"id": id, "rep_id": f"rep_{id}"})


def _round(rows: DataFrame, pairs: DataFrame, kind: str, words: int, threshold: float, part: int, nth: int) -> DataFrame:
    """The pairs' words brought together at the text that stands for each, and judged."""
    before, after = F.least(_left("w"), _left("rw")), F.least(_right("w"), _right("rw"))
    more = F.greatest(F.floor((before + after + 1) / 3) + 1, F.lit(words))
    low, high = F.shiftright("rw", 32) - before - more, F.shiftright("rw", 32) + after + more
    reps = pairs.groupBy("rep").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts"))
    reps = written(reps, "reps")
    hot = reps.where("parts > 1").select("rep", "parts")
    placed = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")
    own = pairs.join(written(hot, "hot-reps"), "rep", "left").select("row", "rep", placed.alias("part"), "w", "x", "rw")
    standing = reps.select(F.col("rep").alias("row"), "rep", (-F.col("parts")).alias("part"), F.col("low").alias("w"), F.lit(0).cast("long").alias("x"), F.col("high").alias("rw"))
    needs = own.union(standing)
    if nth:  # few texts are left
        asked = written(needs.select("row").distinct(), "asked")
        rows = rows.join(asked, "row", "left_semi")
    nothing = {c: F.lit(None).cast(t) for c, t in (("rep", "long"), ("part", "int"), ("w", "long"), ("x", "long"), ("rw", "long"))}
    both = rows.select("row", "id", "text", *(v.alias(c) for c, v in nothing.items())).union(needs.select("row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), *nothing))
    cut = lambda batches: _cut(batches, words)
    sent = both.repartition("row").sortWithinPartitions("row", F.col("text").isNull()).mapInArrow(cut, f"rep long, part int, other int, row long, id {kind}, shift long, `from` long, rep_from long, rep_to long, words binary, places binary")
    judge = lambda batches: _judged(batches, words, threshold)
    return sent.repartition("rep", "part").sortWithinPartitions("rep", "part", "other", "row").mapInArrow(judge, f"id {kind}, start long, n_words long, rep_id {kind}, rep_start long, rep_n_words long, similarity double, key long, row long, w long, x long")
