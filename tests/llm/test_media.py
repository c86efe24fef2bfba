"""Exact round trips, and files against a plain decoder that follows the standard bit by bit."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import jpeg, media


def plain_decode(file):
    """Coefficients by component of a baseline file, one bit at a time."""
    at, q, huff, comps, restart = 2, {}, {}, [], 0
    while True:
        marker, size = file[at + 1], struct.unpack_from(">H", file, at + 2)[0]
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC0:
            h, w = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                bits, code, j, table = body[k + 1 : k + 17], 0, k + 17, {}
                for length, n in enumerate(bits, 1):
                    for _ in range(n):
                        table[length, code] = body[j]
                        code, j = code + 1, j + 1
                    code <<= 1
                huff[body[k]] = table
                k = j
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    bits = []
    segments, current = [], bytearray()
    i = at
    while i < len(file):
        if file[i] == 0xFF:
            if file[i + 1] == 0:
                current.append(0xFF)
            else:
                segments.append(bytes(current))
                current = bytearray()
            i += 2
        else:
            current.append(file[i])
            i += 1
    single = len(comps) == 1
    mh, mv = (1, 1) if single else (max(c[1] for c in comps), max(c[2] for c in comps))
    mcus = -(-w // (8 * mh)) * -(-h // (8 * mv))
    out, done = [[] for _ in comps], 0
    for segment in segments:
        bits = "".join(f"{b:08b}" for b in segment)
        p, pred = 0, [0] * len(comps)

        def symbol(table):
            nonlocal p
            for n in range(1, 17):
                if (s := table.get((n, int(bits[p : p + n], 2)))) is not None:
                    p += n
                    return s
            raise AssertionError

        def number(n):
            nonlocal p
            v = int(bits[p : p + n] or "0", 2)
            p += n
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(restart or mcus, mcus - done)):
            done += 1
            for c, (_, ch, cv) in enumerate(comps):
                for _ in range(1 if single else ch * cv):
                    block = [0] * 64
                    pred[c] += number(symbol(huff[tables[c][0]]))
                    block[0], k = pred[c], 1
                    while k < 64:
                        s = symbol(huff[0x10 | tables[c][1]])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = number(s & 15)
                        k += 1
                    out[c].append(block)
    return [np.array(b) for b in out]


def foreign(width, height, sampling, restart, rng, long_codes=False):
    """A baseline file of another writer: DC predicted across MCUs, runs of zeros, subsampling, its own tables and quantisation."""
    dc = list(range(12))
    ac = [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    dc_bits = [0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0]
    ac_bits = [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 160, 0] if long_codes else [0, 1, 1, 0, 0, 0, 0, 0, 0, 160, 0, 0, 0, 0, 0, 0]
    codes = {}
    for cls, b, s in ((0, dc_bits, dc), (1, ac_bits, ac)):
        code, k = 0, 0
        for length, n in enumerate(b, 1):
            for _ in range(n):
                codes[cls, s[k]] = f"{code:0{length}b}"
                code, k = code + 1, k + 1
            code <<= 1
    comps = [(i + 1, h, v) for i, (h, v) in enumerate(sampling)]
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes([3] * 64))
    head += jpeg._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(comps)) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in comps))
    head += jpeg._segment(0xC4, bytes([0x00, *dc_bits, *dc])) + jpeg._segment(0xC4, bytes([0x10, *ac_bits, *ac]))
    head += (jpeg._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + jpeg._segment(0xDA, bytes([len(comps)]) + b"".join(bytes([i, 0]) for i, *_ in comps) + b"\x00\x3f\x00")
    mh, mv = (1, 1) if len(comps) == 1 else (max(c[1] for c in comps), max(c[2] for c in comps))
    mcus = -(-width // (8 * mh)) * -(-height // (8 * mv))
    blocks, body, bits, pred, mark = [[] for _ in comps], b"", "", [0] * len(comps), 0

    def value(v):
        n = abs(v).bit_length()
        return n, "" if not n else f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    def flush():
        raw = bits + "1" * (-len(bits) % 8)
        return bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(mcus):
        if restart and m and m % restart == 0:
            body, bits, pred, mark = body + flush() + bytes([0xFF, 0xD0 + mark % 8]), "", [0] * len(comps), mark + 1
        for c, (_, h, v) in enumerate(comps):
            for _ in range(1 if len(comps) == 1 else h * v):
                block = [rng.randint(-500, 500)] + [rng.choice([0, 0, 0, 0, 1, -3, rng.randint(-900, 900)]) if rng.random() < 0.4 else 0 for _ in range(63)]
                blocks[c].append(block)
                n, extra = value(block[0] - pred[c])
                bits += codes[0, n] + extra
                pred[c], run = block[0], 0
                for k in range(1, 64):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + codes[1, 0xF0], run - 16
                    n, extra = value(block[k])
                    bits, run = bits + codes[1, run << 4 | n] + extra, 0
                if run:
                    bits += codes[1, 0]
    return head + body + flush() + b"\xff\xd9", [np.array(b) for b in blocks]


@pytest.mark.parametrize("long_codes", [False, True])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_files_of_other_writers(sampling, restart, long_codes):
    rng = random.Random(str((sampling, restart)))
    file, want = foreign(53, 37, sampling, restart, rng, long_codes)
    frame, got = jpeg.decode([file])[0]
    assert all((g == w).all() and (p == w).all() for g, w, p in zip(got, want, plain_decode(file), strict=True))
    image = jpeg.thumbnail(frame, got)
    n = 1 if len(sampling) == 1 else sampling[0][0]
    assert image.shape[1] >= -(-53 // 8) and image[0, 0] == np.clip((want[0][0][0] * 3 + 4 >> 3) + 128, 0, 255) and n
    with pytest.raises(jpeg.Unreadable):
        jpeg.payload(frame, got)


def test_round_trips_and_the_plain_decoder():
    rng = random.Random(2)
    payloads = [media.padded(x) for x in (b"", b"a", bytes(576), b"\x80" * 1000, rng.randbytes(4000), bytes(rng.choice([128, 128, 128, 255, 0, 127]) for _ in range(4000)), "äé".encode() * 300)]
    files = jpeg.encode(payloads)
    for file, payload, (frame, blocks) in zip(files, payloads, jpeg.decode(files), strict=True):
        assert jpeg.payload(frame, blocks) == payload
        assert all((a == b).all() for a, b in zip(blocks, plain_decode(file), strict=True))
        assert jpeg.encode([payload]) == [file]


def test_very_large_image_has_a_last_row_to_fill():
    payload = bytes(range(192)) * 8209  # a prime number of MCUs over the longest side
    assert jpeg.payload(*jpeg.decode(jpeg.encode([payload]))[0]) == payload


def test_queries_rows(odd, empty):
    got = media.read_media(media.with_media(odd)).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(got) == len(texts)
    for (doc, text), r in zip(sorted(texts, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(texts).get(r.doc_id)))), strict=True):
        raw = (text or "").encode()
        payload = media.padded(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None)
    same = [r for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert media.read_media(media.with_media(empty)).collect() == []


def test_damaged_files_are_told(spark):
    good = jpeg.encode([media.padded(b"hello")])[0]
    df = spark.createDataFrame([(1, good), (2, good[:200]), (3, b"no"), (4, None), (5, good[:-40] + b"\xff\xd9")], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.read_media(df).collect()}
    assert got[1].error is None and got[1].payload_bytes == 192
    assert all(got[i].error and got[i].payload_sha256 is None for i in (2, 3, 4, 5))


def test_a_thousand_damaged_files_are_told(spark):
    """Cut, changed and made-up files: each gives a row, with a reason or with what can be read."""
    rng = random.Random(11)
    good = jpeg.encode([media.padded(bytes(rng.randrange(256) for _ in range(n))) for n in (10, 500, 3000)])
    files = [struct.pack(">HHHBHHBBBB", 0xFFD8, 0xFFC0, 11, 8, 65535, 65535, 1, 1, 0x11, 0), b"", b"\xff\xd8", b"\xff\xd8\xff\xdd\x00\x03\x01"]
    while len(files) < 1000:
        x = bytearray(rng.choice(good))
        how = rng.randrange(4)
        if how == 0:
            del x[rng.randrange(len(x)) :]
        elif how == 1:
            a = rng.randrange(len(x))
            del x[a : a + rng.randrange(1, 40)]
        else:
            for _ in range(rng.randrange(1, 6)):
                x[rng.randrange(min(len(x), 700 if how == 2 else len(x)))] = rng.randrange(256)
        files.append(bytes(x))
    head = good[0].index(b"\xff\xc0")
    for value in (b"\xff\xff\xff\xff", b"\x00\x00\x00\x00"):  # a frame that claims very many samples, or none
        files.append(good[0][: head + 5] + value + good[0][head + 9 :])
    files.append(good[0][: head + 11] + b"\x00" + good[0][head + 12 :])  # a sampling factor of 0
    rows = media.read_media(spark.createDataFrame(list(enumerate(map(bytearray, files))), "doc_id long, media binary").repartition(4)).collect()
    assert len(rows) == len(files)
    errors = {r.doc_id for r in rows if r.error}
    assert {0, 1, 2, 3, 1000, 1001, 1002} <= errors and len(errors) > 300
    assert all(r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest() for r in rows)
