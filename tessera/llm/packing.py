"""Packing of token sequences: window cuts by order-preserving dynamic programming.

The tokens of a partition's documents form one stream, in the order of the rows. A window is a stretch of at most
``window`` tokens. Cuts may fall at document ends (no penalty), at sentence ends (``SENTENCE`` tokens), or, only inside a
long stretch without sentence ends, at even steps (``ANYWHERE``). The cost of a packing is its padding plus these penalties. With
best[j] the least cost of windows that end at boundary j at position p(j),

    best[j] = penalty[j] + window - p(j) + min(best[i] + p(i))   over i < j with p(j) - p(i) <= window

and the minimum over the sliding range of i comes from a monotone queue, so time is linear in the boundaries. The stream
is worked on in blocks of about ``BLOCK`` tokens; the windows of a block but the last are kept and the rest of its tokens
join the next block. Memory is bounded by a block, whatever the partition. A partition's last tokens are cut into
lengths that are powers of two, which need no padding.

No row is shuffled: each task packs the rows it has read, and ``sequence_id`` counts on from a number of the task's own.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens as T
from tessera.llm import words as W

WIDE = 128
#: Penalties of a cut in tokens of padding, and tokens in a block. Within a stretch without a sentence end of over
#: ``window // WIDE`` tokens, cuts may fall every ``window // (4 * WIDE)`` tokens.
SENTENCE, ANYWHERE, BLOCK = 16, 64, 1 << 20
#: Signs that end a sentence, of Latin, Armenian, Arabic, Indic, Ethiopic, Burmese, Khmer and East Asian texts.
SENTENCE_ENDS = ".!?…։؟۔।॥።፧။៕。！？｡"


@lru_cache(maxsize=2)
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, 1 if its token ends a sentence, 2 if it is a number or begins with a digit, else 0."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int8)
    byte_of = {letter: byte for byte, letter in T._byte_letters().items()}
    for token, i in vocabulary.items():
        letters = token.removesuffix("</w>")
        word = bytes(byte_of.get(c, 32) for c in letters).decode("utf-8", "ignore")
        # scripts without spaces put their signs within a pre-token's run of other signs, at its end or not
        out[i] = 2 if word[:1].isdigit() else word[-1:] in SENTENCE_ENDS and bool(word) and (letters != token or not word.isascii())
    return out


def cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indexes of the boundaries where the cheapest packing cuts; the first and last boundary are among them.

    ``positions`` rise strictly and neighbours differ by at most ``window``. The last stretch is free of padding.
    """
    p, fee, n = positions.tolist(), penalties.tolist(), len(positions)
    value, before = [0] * n, [0] * n  # value: best + position
    value[0] = p[0]
    queue = deque([0])
    for j in range(1, n - 1):
        at = p[j]
        low = at - window
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        before[j] = i
        x = value[j] = value[i] + fee[j] + window
        while queue and value[queue[-1]] > x:
            queue.pop()
        queue.append(j)
    low = p[-1] - window  # the last stretch is carried on or cut into powers of two: it costs its own tokens, not a window
    j = min((i for i in range(n - 2, -1, -1) if p[i] >= low), key=lambda i: value[i] - p[i])
    out = [n - 1, j]
    while j:
        j = before[j]
        out.append(j)
    return out[::-1]


class _Stream:
    """Tokens that wait for a window, with the documents they belong to."""

    def __init__(self, window: int, ends: np.ndarray, serial: int):
        self.window, self.ends, self.serial = window, ends, serial
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int, int]] = []  # id, tokens of the document, the first that waits, how many wait
        self.size = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc, len(ids), 0, len(ids)))
        self.size += len(ids)

    def flush(self, last: bool):
        """Rows of the windows that are settled; all of them if ``last``."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([d[3] for d in self.docs])
        kind = self.ends[ids]
        sentence = np.flatnonzero((kind[:-1] == 1) & (kind[1:] != 2)) + 1  # a point before a digit ends nothing
        positions = np.unique(np.concatenate(([0], sentence, doc_ends)))
        fees = np.full(len(positions), SENTENCE, np.int64)
        fees[np.searchsorted(positions, doc_ends)] = 0
        gaps = np.diff(positions)
        if (wide := np.flatnonzero(gaps > max(1, self.window // WIDE))).size:
            step = max(1, self.window // (4 * WIDE))
            more = np.concatenate([np.arange(positions[k] + step, positions[k + 1], step) for k in wide.tolist()])
            where = np.searchsorted(positions, more)
            positions, fees = np.insert(positions, where, more), np.insert(fees, where, ANYWHERE)
        at = positions[cuts(positions, fees, self.window)].tolist()
        if last and at[-1] - at[-2] < self.window:  # the last window, in powers of two
            rest, p = at[-1] - at[-2], at[-2]
            tail = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
            at = at[:-1] + (p + np.cumsum(tail)).tolist()
        windows = list(zip(at[:-1], at[1:], strict=True)) if last else list(zip(at[:-2], at[1:-1], strict=True))
        raw = np.ascontiguousarray(ids, "<u4")
        k, begin = 0, 0  # the document at hand and where its waiting tokens begin
        for a, b in windows:
            x = a
            while x < b:
                while begin + self.docs[k][3] <= x:
                    begin += self.docs[k][3]
                    k += 1
                doc, total, first, waiting = self.docs[k]
                y = min(b, begin + waiting)
                yield doc, first + x - begin, y - x, zlib.crc32(raw[x:y]), total, self.serial, x - a
                x = y
            self.serial += 1
        done = windows[-1][1] if windows else 0
        kept = []
        for (doc, total, first, waiting), end in zip(self.docs, doc_ends.tolist(), strict=True):
            if end > done:
                skip = max(0, done - (end - waiting))
                kept.append((doc, total, first + skip, waiting - skip))
        self.docs, self.ids, self.size = kept, [ids[done:]] if done < len(ids) else [], len(ids) - done


def pack(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", end_id: int = 2, window: int = 4096, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A document is the ids of its whole text and ``end_id``. Pieces of one sequence follow each other from offset 0 without
    gaps. A null or empty text is a document of the end id alone; equal rows are packed each; an empty table gives no
    pieces; a null id is kept as null. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    first = spark.sparkContext.broadcast(T.frequent(docs, path, text))
    kind = docs.schema[id].dataType.simpleString()
    names = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]

    def run(batches):
        encoder = T.worker_encoder(path, first)
        stream = _Stream(window, _sentence_ends(path), TaskContext.get().partitionId() << 40)
        types = [pa.int64()] * 7

        def table(rows):
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            used: dict[int, int] = {}
            for s, o, n in zip(columns[5], columns[6], columns[2], strict=True):
                used[s] = max(used.get(s, 0), o + n)
            pads = {s: n if n & (n - 1) == 0 else window for s, n in used.items()}
            return pa.RecordBatch.from_arrays([*arrays, pa.array([pads[s] for s in columns[5]], pa.int64())], names)

        for batch in batches:
            types[0] = batch.schema.field("id").type
            for part in W.slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("id").to_pylist(), encoder.ids(texts), strict=True):
                    stream.add(doc, np.append(ids, np.uint32(end_id)).astype(np.uint32))
                    if stream.size >= block and (rows := list(stream.flush(False))):
                        yield table(rows)
        if rows := list(stream.flush(True)):
            yield table(rows)

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")
