import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from seqloom.llm import media


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 100, bytes(range(256)) * 40, b"abcabcabd" * 3000, np.random.default_rng(1).integers(0, 4, 70_000, np.uint8).tobytes()])
def test_codecs_round_trip(data):
    assert media.packbits_decode(media.packbits_encode(data)) == data
    assert media.lzw_decode(media.lzw_encode(data)) == data


def test_packbits_of_the_format_specification():
    packed = bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))
    assert media.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.ADOBE_DEFLATE, media.PACKBITS])
def test_files_round_trip(order, tile, predictor, compression):
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 9, (37, 21, 1), np.uint8), rng.integers(0, 60_000, (16, 16, 3), np.uint16), rng.integers(0, 255, (1, 64, 1), np.uint8)]
    back = list(media.decode(media.encode(images, compression, predictor, order, 8, tile)))
    assert len(back) == 3 and all((a == b).all() and a.shape == b.shape for a, b in zip(images, back, strict=True))


def test_pages_and_damage(spark):
    good = media.encode([np.zeros((2, 3, 1), np.uint8)] * 2)
    rows = [(1, good, 5), (2, b"junk", 5), (3, None, 5), (4, good[:40], 5), (5, b"", 5)]
    df = spark.createDataFrame(rows, "doc_id long, file binary, page int")
    got = [tuple(r) for r in media.pages(df, "doc_id", "file").select("_id", "page", "width", "height").sort("_id", "page").collect()]
    assert got == [(1, 0, 3, 2), (1, 1, 3, 2), (2, -1, None, None), (4, -1, None, None), (5, -1, None, None)]


def by_hand(strips, **tags):
    """A little-endian file of one page: strips, then a directory of longs by number."""
    out, offsets = bytearray(b"II*\0\0\0\0\0"), []
    for s in strips:
        offsets.append(len(out))
        out += s
    fields = {273: offsets, 279: list(map(len, strips))} | {int(k[1:]): v if isinstance(v, list) else [v] for k, v in tags.items()}
    fields = {k: v for k, v in fields.items() if v != [None]}
    places = {}
    for k, v in fields.items():
        if len(v) > 1:
            places[k] = len(out)
            out += struct.pack(f"<{len(v)}I", *v)
    struct.pack_into("<I", out, 4, len(out))
    out += struct.pack("<H", len(fields))
    for k in sorted(fields):
        out += struct.pack("<HHII", k, 4, len(fields[k]), places.get(k, fields[k][0] if fields[k] else 0))
    return bytes(out + b"\0\0\0\0")


def test_bits_planes_and_floats():
    bits = np.random.default_rng(2).integers(0, 2, (5, 13, 1), np.uint8)
    rows = np.packbits(bits[:, :, 0], axis=1).tobytes()
    (got,) = media.decode(by_hand([media.packbits_encode(rows)], t256=13, t257=5, t258=1, t259=32773, t278=5))
    assert (got == bits).all()
    image = np.random.default_rng(3).integers(0, 256, (6, 7, 3), np.uint8)
    strips = [image[y : y + 4, :, c].tobytes() for c in range(3) for y in (0, 4)]
    (got,) = media.decode(by_hand(strips, t256=7, t257=6, t258=[8, 8, 8], t277=3, t278=4, t284=2))
    assert (got == image).all()
    floats = np.linspace(-3, 900, 40, dtype=">f4").reshape(4, 10)
    split = floats.view(np.uint8).reshape(4, 10, 4).transpose(0, 2, 1).reshape(4, 40)
    packed = np.concatenate([split[:, :1], split[:, 1:] - split[:, :-1]], axis=1)
    (got,) = media.decode(by_hand([zlib.compress(packed.tobytes())], t256=10, t257=4, t258=32, t259=8, t278=4, t317=3))
    assert (got.view("f4")[:, :, 0] == floats).all()


def test_hostile_files_give_a_row_each(spark):
    raw = bytes(64)
    files = [
        by_hand([raw], t256=8, t257=8, t258=8, t278=0),
        by_hand([raw], t256=8, t257=8, t258=8, t278=8, t324=[8, 8], t322=16, t323=16),
        by_hand([raw], t256=8, t257=8, t258=8, t324=8, t325=64, t322=8),
        by_hand([raw], t256=2**31, t257=2**31, t258=8, t278=2**31),
        by_hand([zlib.compress(bytes(100))], t256=2**20, t257=2**20, t258=16, t259=8, t278=2**20),
        by_hand([raw], t256=2**20, t257=2**31, t258=8, t278=1),
        by_hand([raw], t256=8, t257=8, t258=[8, 16, 8], t277=3, t278=8),
        by_hand([raw], t256=8, t257=8, t258=1, t278=8, t317=2),
        by_hand([raw], t256=8, t257=8, t258=8, t278=8, t259=7),
        by_hand([raw], t256=8, t257=8, t258=8, t278=8, t277=0),
        by_hand([], t256=8, t257=8, t258=8, t278=8),
        by_hand([b"\x80\x40\x20junk"], t256=8, t257=8, t258=8, t278=8, t259=5),
    ]
    good = media.encode([np.arange(64, dtype=np.uint8).reshape(8, 8, 1)], media.LZW, 2)
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            assert all(x.size <= 4096 * len(bad) for x in media.decode(bytes(bad)))
        except media.BadTiff:
            pass
    df = spark.createDataFrame([(k, f) for k, f in enumerate([*files, good])], "doc_id long, file binary")
    got = {r._id: (r.page, r.error) for r in media.pages(df, "doc_id", "file").collect()}
    assert all(got[k][0] == -1 and got[k][1] for k in range(len(files))) and got[len(files)] == (0, None)


def plain_feature(payload):
    rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
    n, mean = len(payload), sum(payload) / len(payload)
    var = sum((x - mean) ** 2 for x in payload) / n
    step = sum(abs(a - b) for r in rows for a, b in zip(r, r[1:])) / n
    return 64, len(rows), -(-len(rows) // media.PAGE_ROWS), mean, var, payload.count(0) / n, step


def test_features_against_plain_sums_in_every_layout():
    rng, seen = random.Random(9), set()
    for k in range(400):
        data, _ = media.payload("".join(rng.choice("aé ##zz") for _ in range(rng.choice([0, 40, 900]))) + str(k))
        tiff = media.text_tiff(data)
        read = list(media._file_pages(tiff))
        assert b"".join(x[4] for x in read) == data
        tags = next(media._directories(tiff))
        seen.add((tags[0], tags[1][media.COMPRESSION_TAG][0], tags[1][media.PREDICTOR_TAG][0], media.TILE_OFFSETS_TAG in tags[1]))
        got = media.features(read[0][1], [x[4] for x in read]).replace("x", " ", 1).replace("=", " ").split()
        got = [float(x) for x in got if x[0].isdigit()]
        assert got == pytest.approx(plain_feature(data), abs=1e-5)
    assert len({x[1] for x in seen}) == 5 and len(seen) > 20


def test_digest_of_edge_cases(spark):
    texts = [None, "", "é" * 32, "x" * 700_000, "é" * 32]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, tiff string")
    got = {r.doc_id: r for r in media.media_digest(df).collect()}
    assert media.media_digest(df.limit(0)).count() == 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(full))
        assert got[i].payload_sha256 == hashlib.sha256(full).hexdigest() and got[i].tail_crc32 == zlib.crc32(full[-64:])
    assert got[0].media_sha256 == got[1].media_sha256 and got[2].feature == got[4].feature
