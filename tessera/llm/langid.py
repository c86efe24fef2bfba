"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter for all languages: each of its slots is a bit mask with one bit per language, so one read of ``HASHES`` slots,
ANDed, gives every language whose filter contains an n-gram. A text's n-grams are looked up at once; a popcount per
language, corrected for the filter's false positives, decides.

Fitting counts, for every n-gram, the labelled documents of each language that hold it, and keeps those in at least
``MIN_SHARE`` of a language's documents. A document of d distinct n-grams adds d to the counts, so no language keeps more
than (mean d) / MIN_SHARE n-grams whatever the corpus, and never more than ``MOST_GRAMS``: this bounds the filter that is broadcast. Of each language, about
``FIT_DOCS`` labelled documents are used at most, chosen by a hash of the document id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W

N, HASHES, MIN_SHARE, FIT_DOCS, BITS_PER_GRAM = 4, 3, 0.02, 4000, 16
#: N-grams that a language's filter holds at most, the most frequent ones.
MOST_GRAMS = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter, else a space; and whether it is one."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.full(0x110000, 32, np.uint32)
    for i in np.flatnonzero(letter).tolist():
        x = chr(i).lower()
        lower[i] = ord(x[0])
    return lower, letter


def grams(texts: list[str], n: int = N, begins: list[bool] | None = None, ends: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of ``texts``, one text after the other, where each text's begin, and whether it has a letter.

    Anything but letters counts as a space, and runs of spaces as one; a space stands before and after a text, but where
    ``begins`` or ``ends`` says that it is the later or earlier part of a longer one. N-grams do not reach from one text into another.
    """
    lower, _ = _letters()
    begins, ends = begins or [True] * len(texts), ends or [True] * len(texts)
    padded = [" " * a + x + " " * b for x, a, b in zip(texts, begins, ends, strict=True)]
    chars = lower[W.code_points("".join(padded))]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))))
    is_letter = chars != 32
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a letter, or the first space after one
    keep[bounds[:-1]] = True
    packed = chars[keep].astype(np.uint64)
    before = np.concatenate(([0], np.cumsum(keep)))[bounds]
    letters = np.diff(np.concatenate(([0], np.cumsum(is_letter)))[bounds])
    counts = np.maximum(np.diff(before) - n + 1, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros(len(packed), np.uint64)
    padded = np.concatenate((packed, np.zeros(n, np.uint64)))
    for i in range(n):
        total = (total + padded[i : i + len(packed)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    valid = np.ones(len(packed), bool)
    for i in range(1, n):  # the last n - 1 of each text begin no n-gram
        valid[np.maximum(before[1:] - i, before[:-1])] = False
    return W.mix(total[valid]), ends, letters > 0


def _carried(text: str, cut: int, n: int = N) -> tuple[int, bool]:
    """Where the part of ``text`` after ``cut`` has to begin, so that its n-grams are those that end after the cut: ``n - 1`` characters before, as ``grams`` counts them; and whether a space before the text is one of them."""
    kept = 0
    while cut > 0 and kept < n - 1:
        cut -= 1
        kept += text[cut].isalpha() or cut > 0 and text[cut - 1].isalpha()
    return cut, kept < n - 1


def _grouped(texts: list[str], most: int = W.SEGMENT):
    """Indexes and texts in groups of bounded size, and whether each begins and ends its text: a long one comes in parts, with every n-gram in one of them."""
    index, group, begins, ends, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for k in range(0, max(1, len(text)), most):
            first, whole = _carried(text, k) if k else (0, True)
            part = text[first : k + most]
            index.append(i)
            group.append(part)
            begins.append(whole)
            ends.append(k + most >= len(text))
            size += len(part)
            if size > most:
                yield np.array(index), (group, N, begins, ends)
                index, group, begins, ends, size = [], [], [], [], 0
    if group:
        yield np.array(index), (group, N, begins, ends)


@dataclass
class Filters:
    """Bit-sliced Bloom filters of ``languages``: ``slots`` holds one mask of 64 languages per column."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], bits: int = BITS_PER_GRAM) -> Filters:
        languages = sorted(by_language)
        most = max((len(x) for x in by_language.values()), default=0)
        n = 1 << max(10, int(np.ceil(np.log2(max(1, most) * bits))))
        slots = np.zeros((n, max(1, -(-len(languages) // 64))), np.uint64)
        for k, language in enumerate(languages):
            for at in cls.places(by_language[language], n):
                slots[at, k >> 6] |= np.uint64(1 << (k & 63))
        fill = np.array([float(np.mean(slots[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1))) for k in range(len(languages))])
        return cls(languages, slots, fill)

    @staticmethod
    def places(hashes: np.ndarray, n: int):
        step = hashes >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * step) & np.uint64(n - 1)).astype(np.int64)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """The masks of the languages that contain each n-gram."""
        out = None
        for at in self.places(hashes, len(self.slots)):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and number of n-grams of each text; the score is the corrected share of its n-grams that the language contains."""
        hits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        has = np.zeros(len(texts), bool)
        for index, group in _grouped(texts):
            hashes, bounds, letters = grams(*group)
            np.logical_or.at(has, index, letters)
            np.add.at(n, index, np.diff(bounds))
            masks = self.containing(hashes)
            for k in range(len(self.languages)):
                found = np.cumsum((masks[:, k >> 6] >> np.uint64(k & 63) & np.uint64(1)).astype(np.int32), dtype=np.int64)
                np.add.at(hits[:, k], index, np.diff(np.concatenate(([0], found))[bounds]))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), n
        wrong = self.fill**HASHES
        share = (hits / np.maximum(n, 1)[:, None] - wrong) / np.maximum(1 - wrong, 1e-9)
        best = share.argmax(1)
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0), n


def fit(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS, min_share: float = MIN_SHARE) -> Filters:
    """Filters of the languages of ``labelled``; rows whose text or language is null teach nothing. Equal inputs give equal filters."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters.build({})
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, fit_docs / n))))
    rows = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out():
            for language, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for part in W.slices(batch, "text"):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for language in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == language]
                    for i, t in enumerate(own):
                        parts = [np.unique(grams(*group)[0]) for _, group in _grouped([t])]
                        found = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
                        held.setdefault(language, []).append(found)
                        size += len(found)
                    if size > 1 << 22:
                        yield from out()
                        held.clear()
                        size = 0
        yield from out()

    used = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for k, n in sorted(used.items()) for x in (k, max(1.0, min_share * n)))) if used else None
    if least is None:
        return Filters.build({k: np.empty(0, np.uint64) for k in sizes})
    kept = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")])
    # a language keeps no more n-grams than a document has on average, over the least share; this is the bound of the model by number
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    table = kept.withColumn("nth", nth).where(F.col("nth") <= MOST_GRAMS).select("lang", "gram").toPandas()
    return Filters.build({k: table.gram[table.lang == k].to_numpy(np.int64).view(np.uint64) for k in sizes})


def identify(docs: DataFrame, filters: Filters, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, lang_pred, score and n_grams of every row, with the columns ``keep`` passed through.

    lang_pred is one of the filters' languages, ``und`` where the text is null or has no letter (or nothing was learned);
    score, 0 to 1, is the corrected share of the text's n-grams that the language contains. Ties go to the first language
    in order. One row in, one row out: repeated rows and null ids stay; an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    names = [f"c{i}" for i in range(len(keep) + 1)]  # columns go by place: any of their names may be one of the result's
    given = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip((id, *keep), names, strict=True)), F.col(f"`{text}`").alias("text"))
    schema = given.drop("text").schema.add("lang_pred", "string").add("score", "double").add("n_grams", "long")

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                lang, score, n = model.value.predict([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], [*names, "lang_pred", "score", "n_grams"])

    return given.mapInArrow(run, schema).toDF(id, *keep, "lang_pred", "score", "n_grams")
