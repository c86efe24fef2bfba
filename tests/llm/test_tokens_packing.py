"""Counts and packed ids against the library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def test_ids_of_any_characters_are_the_library_s(library, tokenizer):
    own = tokens.Encoder(tokenizer)
    pool = [chr(i) for i in range(0x300)] + list("ab 12 \n") * 9 + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'S", "é", "é", "Σ", "中文", " ", "😀", "\x00", " "]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_cut_between_pre_tokens(library, tokenizer):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcde.é'") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    own = tokens.Encoder(tokenizer)
    parts = [(k.tolist(), len(s.bounds) - 1) for k, s in own.splits([long, "x" * 3000, "b"], 1000)]
    assert len(parts) > 5
    old, tokens.W.SEGMENT = tokens.W.SEGMENT, 1000
    try:
        assert sum(np.diff(s.bounds).sum() for _, s in own.splits([long], 1000)) == sum(np.diff(s.bounds).sum() for _, s in own.splits([long], 10**9))
    finally:
        tokens.W.SEGMENT = old
    assert own.ids([long])[0].tolist() == library.encode(long, add_special_tokens=False).ids


def test_the_worker_table_grows_and_starts_again(tokenizer, library, monkeypatch):
    monkeypatch.setattr(tokens, "WORKER_ENTRIES", 50)
    own = tokens.Encoder(tokenizer)
    texts = [f"word{i} thing{i * 7}" for i in range(400)]
    for _ in range(2):
        for t in texts:
            assert own.counts([t])[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_counts(spark, odd, empty, tokenizer, library):
    got = tokens.token_counts(odd, tokenizer, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokens.token_counts(empty, tokenizer).collect() == []


def check_pieces(rows, docs, library, window):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.padded_to for r in pieces} == {at if at & (at - 1) == 0 else window}
        padding, total = padding + pieces[0].padded_to - at, total + at
    return padding / total


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_packing_is_whole_and_gapless(spark, tokenizer, library, block):
    rng = random.Random(5)
    docs = {i: "".join(rng.choice(["the ", "of a ", "words ", "end. ", "!? "]) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for i in range(60)} | {99: "z" * 900, 100: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(df, tokenizer, window=256, block=block).collect()
    assert check_pieces(rows, docs, library, 256) < 0.05


def test_packing_odd_rows(odd, empty, tokenizer):
    rows = packing.pack(odd, tokenizer).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id is None) > 1
    assert packing.pack(empty, tokenizer).collect() == []


def test_cuts_are_the_cheapest():
    """Against every way to cut."""
    rng = random.Random(6)
    for _ in range(200):
        n, window = rng.randint(1, 9), 10
        positions = np.concatenate(([0], np.cumsum([rng.randint(1, window) for _ in range(n)])))
        fees = np.array([rng.choice([0, 2, 5]) for _ in positions])

        def cost(chosen):
            total = 0
            for a, b in zip(chosen[:-1], chosen[1:]):
                if positions[b] - positions[a] > window:
                    return None
                total += positions[b] - positions[a] if b == n else window + fees[b]
            return total

        best = min(c for mask in range(1 << (n - 1)) if (c := cost([0, *(i + 1 for i in range(n - 1) if mask >> i & 1), n])) is not None)
        assert cost(packing.cuts(positions, fees, window)) == best
