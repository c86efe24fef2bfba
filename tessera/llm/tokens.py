"""Token counts and token ids of whole texts by a public tokenizer file, two tiers and no shuffle of pre-tokens.

The first tier is a compact open-addressing table of the most frequent pre-tokens, made from a bounded sample and
broadcast (``MOST_FREQUENT`` entries at most, so its size has a fixed bound). What it lacks is encoded once by the library
in each Python worker and kept in the worker's own table of the same form, which is bounded too. The sample only decides
what is looked up fast: counts are those of the library for every text whatever it holds.

Texts are cut at white space, which no pre-token of the tokenizer crosses. A stretch between white space that holds only
characters below U+0250, no apostrophe and no start of a special string is split by character class in numpy; any other
stretch goes to the library whole (its result is cached by its text), so contractions, special strings, combining marks
and other scripts follow the library's own rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W

#: Documents in the sample that fits the first tier, the most characters of one, and the entries the tier may have.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_FREQUENT = 2048, 8192, 1 << 16
#: Entries of a worker's own table before it starts again from the first tier.
WORKER_ENTRIES = 1 << 20
#: Longer pre-tokens have no place in the first tier.
LONGEST_KEPT = 256
_SIMPLE = 0x250


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class (0 space, 1 letter, 2 number, 3 other, 4 not simple) and lower case of the characters below U+0250; the last entry stands for the rest."""
    import unicodedata

    kind, lower = np.full(_SIMPLE + 1, 4, np.uint8), np.arange(_SIMPLE + 1, dtype=np.uint32)
    for i in range(_SIMPLE):
        c = chr(i)
        if i in (0x27, 0x130):
            continue
        group = unicodedata.category(c)[0]
        kind[i] = 0 if i in (*range(9, 14), 32, 0x85, 0xA0) else 1 if group == "L" else 2 if group == "N" else 3
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return kind, lower


class Table:
    """Open addressing from 64-bit hashes to the ids of pre-tokens."""

    def __init__(self, slots: int, first: Table | None = None):
        self.keys, self.rows, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0
        self.starts, self.flat, self.size = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0
        if first is not None:
            self.add(first.keys[first.keys != 0], first, first.rows[first.keys != 0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if there is none."""
        top = np.uint64(len(self.keys) - 1)
        at = hashes & top
        got = self.keys[at]
        rows = np.where(got == hashes, self.rows[at], -1).astype(np.int64)
        pending = np.flatnonzero((got != hashes) & (got != 0))
        slot = at[pending]
        while len(pending):
            slot = (slot + np.uint64(1)) & top
            got = self.keys[slot]
            hit = got == hashes[pending]
            rows[pending[hit]] = self.rows[slot[hit]]
            more = ~hit & (got != 0)
            pending, slot = pending[more], slot[more]
        return rows

    def _place(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        top = np.uint64(len(self.keys) - 1)
        slot = hashes & top
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free][::-1]] = hashes[free][::-1]
            mine = free & (self.keys[slot] == hashes)
            self.rows[slot[mine]] = rows[mine]
            hashes, rows, slot = hashes[~mine], rows[~mine], (slot[~mine] + np.uint64(1)) & top

    def put(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Adds distinct hashes that the table lacks."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(ids)
        while self.n + n + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        while self.size + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.size : self.size + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.starts[self.n + 1 : self.n + n + 1] = self.size + np.cumsum(sizes)
        if 2 * (self.n + n) > len(self.keys):
            old, rows = self.keys[self.keys != 0], self.rows[self.keys != 0]
            slots = len(self.keys)
            while 2 * (self.n + n) > slots:
                slots *= 2
            self.keys, self.rows = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._place(old, rows)
        self._place(hashes, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n, self.size = self.n + n, self.size + total

    def add(self, hashes: np.ndarray, other: Table, rows: np.ndarray) -> None:
        self.put(hashes, [other.flat[other.starts[r] : other.starts[r + 1]].tolist() for r in rows.tolist()])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def packed(self) -> dict:
        used = self.keys != 0
        order = np.argsort(self.rows[used])
        return {"keys": self.keys[used][order].tobytes(), "starts": self.starts[: self.n + 1].astype(np.uint32).tobytes(), "flat": self.flat[: self.size].tobytes()}

    @classmethod
    def unpacked(cls, x: dict) -> Table:
        out, keys, starts = cls(1024), np.frombuffer(x["keys"], np.uint64), np.frombuffer(x["starts"], np.uint32)
        if len(keys):
            flat = np.frombuffer(x["flat"], np.uint32)
            out.put(keys, [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)])
        return out


class Split:
    """The pre-tokens of some texts: hash, place in ``chars`` and, per text, how many."""

    def __init__(self, texts: list[str]):
        kind_of, lower = _classes()
        joined = "\n".join(texts)
        raw = W.code_points(joined)
        small = np.minimum(raw, _SIMPLE)
        kind = kind_of[small]
        bar = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        odd = np.flatnonzero(kind == 4)
        odd = np.concatenate((odd, bar)) if len(bar) else odd
        self.joined, self.whole = joined, np.empty((0, 2), np.int64)
        if len(odd):
            space = np.concatenate(([-1], np.flatnonzero(kind == 0), [len(raw)]))
            k = np.unique(np.searchsorted(space, odd))
            self.whole = np.stack((space[k - 1] + 1, space[k]), 1)
            kind = kind.copy()
            sizes = self.whole[:, 1] - self.whole[:, 0]
            kind[np.repeat(self.whole[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))] = 0
        self.chars = lower[small]
        prev = np.concatenate((np.zeros(1, np.uint8), kind))[: len(kind)]
        after = np.concatenate((kind[1:], np.zeros(1, np.uint8)))[: len(kind)]
        starts = np.flatnonzero((kind != 0) & ((kind != prev) | (kind == 2)))
        ends = np.flatnonzero((kind != 0) & ((kind != after) | (kind == 2))) + 1
        lengths = ends - starts
        if len(starts):
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            inside = kind != 0
            place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
            hashes = W.mix(np.add.reduceat((self.chars[inside].astype(np.uint64) + np.uint64(1)) * W._powers()[place & 0xFFFF], first) + lengths.astype(np.uint64))
        else:
            hashes = np.empty(0, np.uint64)
        self.simple = len(starts)
        if len(self.whole):
            # the sign of a stretch that goes to the library whole: its hash is of its own text
            extra = np.fromiter((hash(("whole", joined[a:b])) & W._MASK for a, b in self.whole.tolist()), np.uint64, len(self.whole))
            starts, ends = np.concatenate((starts, self.whole[:, 0])), np.concatenate((ends, self.whole[:, 1]))
            hashes, is_whole = np.concatenate((hashes, extra)), np.concatenate((np.zeros(self.simple, bool), np.ones(len(extra), bool)))
            order = np.argsort(starts, kind="stable")
            starts, ends, hashes, self.is_whole = starts[order], ends[order], hashes[order], is_whole[order]
        else:
            self.is_whole = None
        self.starts, self.ends, self.hashes = starts, ends, np.where(hashes == 0, np.uint64(1), hashes)
        bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.bounds = np.searchsorted(starts, bounds)

    def text(self, i: int) -> tuple[str, bool]:
        a, b = int(self.starts[i]), int(self.ends[i])
        if self.is_whole is not None and self.is_whole[i]:
            return self.joined[a:b], True
        return self.chars[a:b].astype("<u4").tobytes().decode("utf-32-le"), False


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of pre-tokens in one Python worker."""

    def __init__(self, path: str, first: dict | None = None):
        from tokenizers import Tokenizer

        self.library, self.first = Tokenizer.from_file(path), Table.unpacked(first) if first else None
        self.letters = str.maketrans({chr(k): v for k, v in _byte_letters().items()})
        self.long: dict[int, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.table = Table(1 << 12, self.first)

    def one(self, text: str, whole: bool) -> list[int]:
        if whole:
            return self.library.encode(text, add_special_tokens=False).ids
        return [x.id for x in self.library.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def rows(self, split: Split) -> np.ndarray:
        """Row in ``self.table`` of each pre-token."""
        if self.table.n > WORKER_ENTRIES:
            self.reset()
        rows = self.table.find(split.hashes)
        lost = np.flatnonzero(rows < 0)
        if len(lost):
            new, at, back = np.unique(split.hashes[lost], return_index=True, return_inverse=True)
            self.table.put(new, [self.one(*split.text(i)) for i in lost[at].tolist()])
            rows[lost] = (self.table.n - len(new) + np.arange(len(new)))[back]
        return rows

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for k, split in self.splits(texts):
            total = np.concatenate(([0], np.cumsum(self.table.counts(self.rows(split)))))
            np.add.at(out, k, np.diff(total[split.bounds]))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, split in self.splits(texts):
            rows = self.rows(split)
            sizes, starts = self.table.counts(rows), self.table.starts[rows]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            flat = self.table.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(int(ends[-1]))]
            cuts = ends[split.bounds]
            for i, a, b in zip(k.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i].append(flat[a:b])
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.empty(0, np.uint32)]) for x in out]

    @staticmethod
    def splits(texts: list[str], most: int = W.SEGMENT) -> Iterator[tuple[np.ndarray, Split]]:
        """Texts in groups of bounded size; a long one in parts cut at a space or line end (a stretch without any stays whole)."""
        group, index, size = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > most:
                cut = text.rfind(" ", at, at + most)
                cut = text.rfind("\n", at, at + most) if cut <= at else cut
                if cut <= at:
                    found = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
                    cut = min(found, default=len(text))
                group.append(text[at:cut])
                index.append(i)
                yield np.array(index), Split(group)
                group, index, size, at = [], [], 0, cut
            group.append(text[at:])
            index.append(i)
            size += len(text) - at
            if size > most:
                yield np.array(index), Split(group)
                group, index, size = [], [], 0
        if group:
            yield np.array(index), Split(group)


_WORKER: dict[tuple, Encoder] = {}


def worker_encoder(path: str, first) -> Encoder:
    """The worker's encoder; it outlives a task. ``first``: a broadcast of the first tier, or None."""
    key = (path, None if first is None else first.id if hasattr(first, "id") else id(first))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(path, None if first is None else first.value)
    return _WORKER[key]


def frequent(docs: DataFrame, path: str, text: str = "text", sample: int = SAMPLE_DOCS, longest: int = SAMPLE_CHARS, most: int = MOST_FREQUENT) -> dict:
    """The first tier: the ids of the most frequent pre-tokens of about ``sample`` documents, those of at most ``longest`` characters, packed for a broadcast.

    The sample is drawn from all partitions, by chance with a fixed seed, and is twice ``sample`` at most; which documents it
    holds changes no count.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.sample(share, 7).where(F.length("text") <= longest).limit(2 * sample).collect()
    seen: dict[int, list] = {}
    for _, split in Encoder.splits([r["text"] for r in rows]):
        keys, at, n = np.unique(split.hashes, return_index=True, return_counts=True)
        for h, i, c in zip(keys.tolist(), at.tolist(), n.tolist(), strict=True):
            if h in seen:
                seen[h][1] += c
            elif (split.is_whole is None or not split.is_whole[i]) and split.ends[i] - split.starts[i] <= LONGEST_KEPT:
                seen[h] = [split.text(i)[0], c]
    top = sorted(((h, v) for h, v in seen.items() if v[1] > 1), key=lambda x: (-x[1][1], x[0]))[:most]
    encoder, table = Encoder(path), Table(1 << 12)
    if top:
        table.put(np.array([k for k, _ in top], np.uint64), [encoder.one(v[0], False) for _, v in top])
    return table.packed()


def token_counts(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``id``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and ties stay as they are: one row in, one row
    out. An empty table gives an empty table. Other columns are neither read nor returned, whatever their names.
    """
    spark = docs.sparkSession
    first = spark.sparkContext.broadcast(frequent(docs, path, text))

    def count(batches):
        encoder = worker_encoder(path, first)
        for batch in batches:
            for part in W.slices(batch, "text"):
                n = encoder.counts([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").toDF(id, "n_bytes", "n_tokens", "over_limit")
