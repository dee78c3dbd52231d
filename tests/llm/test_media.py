import hashlib
import io
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from spanwise.llm import media
from spanwise.llm.common import table
from tests.llm.helpers import EDGE_TEXTS, edge_docs, rows


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n101\n010\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15\n3 #x\n 15")[:, :, 0].tolist() == [[3, 15]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 9 1\n\x80\x80")[0, :, 0].tolist() == [0] + [255] * 7 + [0]
    assert media.decode(b"P5 2 1 65535\n\x01\x02\x03\x04").tolist() == [[[258], [772]]]
    assert media.decode(b"P6 1 2 255\n\x01\x02\x03\x04\x05\x06").shape == (2, 1, 3)
    for broken in (b"", b"P5", b"P5 2 2 255\n\x01", b"P9 1 1 255\n\x01", b"P5 0 1 255\n", b"P2 1 1 10 11", b"BM", b"\x89PNG", b"P2 1 1 255 -3", b"P1 1 1 2", b"P2 1 1 255 x"):
        with pytest.raises(ValueError):
            media.decode(broken)


@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_round_trips(h, w, data):
    pixels = np.frombuffer(data.draw(st.binary(min_size=h * w * 3, max_size=h * w * 3)), np.uint8).reshape(h, w, 3)
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert (media.decode(media.encode_pgm(pixels[:, :, 0]))[:, :, 0] == pixels[:, :, 0]).all()
    assert (np.load(io.BytesIO(media.npy_bytes(pixels))) == pixels).all()


@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 7), st.integers(1, 7), st.integers(0, 9))
def test_area_resize_against_upsampling(h, w, th, tw, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 1), dtype=np.uint8)
    fine = np.repeat(np.repeat(image, th, 0), tw, 1)[:, :, 0].astype(float)  # each target cell is h x w fine cells
    want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
    assert np.abs(media.area_resize(image, th, tw)[:, :, 0] - want).max() <= 0.5 + 1e-6


def test_query_rows(spark, small):
    for docs in (table(spark, small, "documents"), edge_docs(spark)):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"])
        got = rows(media.media_digests(docs))
        assert len(got) == docs.count()
        for r in got:
            data = (texts[r["doc_id"]][0] or "").encode()
            payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
            assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and len(payload) % 576 == 0
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
            media_bytes = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
            assert (r["media_bytes"], r["media_sha256"]) == (len(media_bytes), hashlib.sha256(media_bytes).hexdigest())
    assert len(EDGE_TEXTS) == edge_docs(spark).count()


def test_tiles(spark, tmp_path):
    images = [media.encode_bmp(np.full((5, 7, 3), 9, np.uint8)), b"junk", None, b""]
    df = spark.createDataFrame([(i, b, "mine") for i, b in enumerate(images)], "id int, image binary, error string")
    got = {r["id"]: r for r in rows(media.decode_tiles(df, side=4))}
    assert (got[0]["height"], got[0]["width"], got[0]["channels"], got[0]["error"]) == (5, 7, 3, None)
    assert (np.load(io.BytesIO(got[0]["tile"])) == 9).all() and np.load(io.BytesIO(got[0]["tile"])).shape == (4, 4, 3)
    assert all(got[i]["tile"] is None and got[i]["error"] for i in (1, 2, 3))
    media.write_tiles(media.decode_tiles(df), str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 1
    assert media.decode_tiles(df.limit(0)).count() == 0


def test_bmp_masks():
    pixels = np.array([[[1, 2, 3], [250, 128, 0]], [[9, 8, 7], [0, 255, 31]]], np.uint8)
    def bmp(masks, values, bits=32):
        body = np.array(values, "<u4").tobytes()
        return b"BM" + media.struct.pack("<IIIIiiHHIIiiII", 66 + len(body), 0, 66, 40, 2, -2, 1, bits, 3, len(body), 0, 0, 0, 0) + media.struct.pack("<III", *masks) + body
    as_rgb = [int(r) << 24 | int(g) << 16 | int(b) << 8 for r, g, b in pixels.reshape(-1, 3)]
    assert (media.decode(bmp((0xFF000000, 0xFF0000, 0xFF00), as_rgb)) == pixels).all()
    assert media.decode(bmp((0x1F, 0x3E0, 0x7C00), [0x7FFF, 0, 0x1F, 0x7C00])).reshape(-1, 3).tolist() == [[255] * 3, [0] * 3, [255, 0, 0], [0, 0, 255]]
    for broken in (bmp((0, 1, 2), [0] * 4), bmp((0x5, 0xF0, 0xF00), [0] * 4), bmp((0xFF, 0xFF00, 0xFF0000), [0] * 4, 24)):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_bands_change_nothing(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (517, 23, 3), dtype=np.uint8)
    whole = [media.area_resize(image, 24, 24), media.area_resize(image, 8, 9, grey=True), media.area_resize(image, 600, 5)]
    grey = np.floor(image.mean(axis=2, keepdims=True)).astype(np.uint8)
    assert (whole[1] == media.area_resize(grey, 8, 9)).all()
    monkeypatch.setattr(media, "BAND", 200)
    assert all((a == b).all() for a, b in zip(whole, [media.area_resize(image, 24, 24), media.area_resize(image, 8, 9, grey=True), media.area_resize(image, 600, 5)], strict=True))


def test_a_long_text_takes_little_more_than_itself():
    image = np.zeros((1_000_000, 24, 1), np.uint8)
    tracemalloc.start()
    media.area_resize(image, 24, 24)
    media.difference_hash(image)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_tiles_replace_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "tiles")
    for n in (3, 2):
        images = [(i, media.encode_pgm(np.full((4, 4), 40 * i + n, np.uint8))) for i in range(n)]
        media.write_tiles(media.decode_tiles(spark.createDataFrame(images, "id int, image binary")), path)
    assert spark.read.parquet(path).count() == 2


def test_numbers_out_of_range_are_an_error_of_their_row(spark):
    df = spark.createDataFrame([(1, bytearray(b"P2 1 1 255 99999999999999999999999")), (2, bytearray(b"P5 99999999999999999999 1 255\n\x00")), (3, bytearray(b"P2 1 1 255 7"))], "i int, image binary")
    got = {r["i"]: r for r in media.decode_tiles(df).collect()}
    assert got[1]["error"] and got[2]["error"] and got[1]["tile"] is None and got[3]["error"] is None
