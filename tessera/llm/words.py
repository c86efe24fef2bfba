"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters and digits of the lower-cased text (``str.isalnum``). Texts of any length are
worked on in segments of bounded size, cut between words, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters that are held as numpy arrays at once.
SEGMENT = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out, x = np.empty(1 << 16, np.uint64), 1
    for i in range(len(out)):
        out[i] = x
        x = x * 0x9E3779B97F4A7C15 & _MASK
    return out


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about SEGMENT characters that do not cut a word (a longer run of letters stays whole)."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = at + SEGMENT
        while cut < len(text) and text[cut - 1].isalnum():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hash_runs(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of each word of a lower-cased string."""
    chars = code_points(joined)
    inside = _alnum()[chars]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = (chars[inside].astype(np.uint64) + np.uint64(1)) * _powers()[place & 0xFFFF]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), starts


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, one text after the other, and where each text begins (one more entry than texts).

    A null text is an empty one.
    """
    hashes, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            found, starts = _hash_runs("\n".join(group))
            bounds = np.cumsum([0] + [len(x) + 1 for x in group])
            hashes.append(found)
            counts.extend(np.diff(np.searchsorted(starts, bounds)).tolist())
            group, size = [], 0

    for text in texts:
        text = (text or "").lower()
        if len(text) > SEGMENT:
            flush()
            parts = [_hash_runs(x)[0] for x in _pieces(text)]
            hashes.extend(parts)
            counts.append(sum(map(len, parts)))
            continue
        group.append(text)
        size += len(text)
        if size > SEGMENT:
            flush()
    flush()
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words within a text, and where each text's begin. A text of fewer words (but one) has one shingle of all its words."""
    counts = np.diff(bounds)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(out_counts)))
    if not len(words):
        return np.empty(0, np.uint64), out_bounds
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for i in range(n):
        total = (total + padded[i : i + len(words)]) * np.uint64(0xD6E8FEB86659FD93 + 2 * i)
    at = np.arange(int(out_bounds[-1])) - np.repeat(out_bounds[:-1], out_counts) + np.repeat(bounds[:-1], out_counts)
    out = mix(total[at])
    for i in np.flatnonzero((counts > 0) & (counts < n)):  # few: very short texts
        x = 0
        for w in words[bounds[i] : bounds[i + 1]].tolist():
            x = (x + w) * 0xD6E8FEB86659FD93 & _MASK
        out[out_bounds[i]] = mix(np.array([x ^ int(counts[i])], np.uint64))[0]
    return out, out_bounds


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``most`` bytes together (at least one row each)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted ``batches`` as tables that hold whole runs of equal keys only."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        end = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if rest and all(rest[0].column(k)[0] == e for k, e in zip(keys, end, strict=True)) and all(batch.column(k)[0] == e for k, e in zip(keys, end, strict=True)):
            rest.append(batch)
            continue
        same = np.ones(batch.num_rows, bool)
        for k, e in zip(keys, end, strict=True):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == e.as_py()
        first = batch.num_rows - int(same.sum())
        if first:
            yield pa.Table.from_batches([*rest, batch.slice(0, first)])
            rest = [batch.slice(first)]
        elif rest and not all(rest[0].column(k)[0] == e for k, e in zip(keys, end, strict=True)):
            yield pa.Table.from_batches(rest)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)
