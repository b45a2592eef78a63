"""Pictures that are a row each: files that are read once, squares that are dealt out once, coders by arrays."""

import random
import struct
import zlib
from urllib.parse import unquote

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators.sequence import MeanRuns
from rasterloom.plans import codecs, measure
from rasterloom.sources import images, tables
from tests.test_measured import pixels, plan


def chunked(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def test_files_are_decoded_as_by_the_image_source(spark, tmp_path):
    noise = random.Random(2).randbytes(4 * 35)
    for n in (1, 2, 3, 4):
        (tmp_path / f"plain{n}.png").write_bytes(images.png(7, 5, noise[: n * 35], n))
    head, rows = struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0), [noise[7 * i : 7 * i + 7] for i in range(5)]
    (tmp_path / "filtered.png").write_bytes(chunked((b"IHDR", head), (b"IDAT", zlib.compress(b"".join(b"\1" + r for r in rows))), (b"IEND", b"")))
    (tmp_path / "told[1].png").write_bytes(chunked((b"IHDR", head), (b"tEXt", b"a\0b"), (b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))), (b"IEND", b"")))
    (tmp_path / "none.png").write_bytes(b"no picture")
    want = {unquote(r.path).rsplit("/", 1)[1]: (r.width, r.height, r.nChannels, bytes(r.data)) for r in spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data").collect()}
    found = images.read_images(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert len(want) == 6 and len(got) == 7 and got["none.png"].error_msg == "cannot be decoded"
    assert {k: (r.w, r.h, r.channels, bytes(r.bgr)) for k, r in got.items() if r.error_msg is None} == want
    plain = {k for k in want if images.decoded_png((tmp_path / k).read_bytes()) == want[k]}
    assert plain == {f"plain{n}.png" for n in (1, 2, 3, 4)}


def test_plain_files_need_neither_a_join_nor_the_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.png(2, 1, bytes(6)))
    found = images.read_images(spark, str(tmp_path))
    assert "Join" not in plan(found) and "image" not in plan(found)


def test_broken_pngs_are_not_decoded():
    good = images.png(3, 2, bytes(range(18)))
    assert images.decoded_png(good)[:3] == (3, 2, 3)
    for i in range(len(good)):
        assert images.decoded_png(good[:i]) is None
        assert images.decoded_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]) is None
    assert images.decoded_png(good + b"x") is None


def test_a_picture_is_measured_where_it_is(spark, tmp_path):
    rows = [(7, "a", 2, 2, 3, bytes(range(12)), None), (8, "b", 3, 1, 1, bytes([5, 5, 9]), None), (9, "c", None, None, None, None, "no")]
    given = spark.createDataFrame(rows, "img_id long, name string, w int, h int, channels int, bgr binary, error_msg string")
    kinds = [codecs.Hufman(), codecs.HilbertRle(3.0)]
    both = codecs.measured_pictures(given, kinds)
    assert "Exchange" not in plan(both)
    got = {(r.name, r.codec): r for r in both.collect()}
    px = images.image_pixels(given, "img_id")
    for c in kinds:
        want = {r.name: r for r in measure.measure(px, c).collect()}
        for i, name in ((7, "a"), (8, "b")):
            assert (got[name, c.name].size, got[name, c.name].error, got[name, c.name].error_msg) == (want[str(i)].compressed_size, want[str(i)].error, None)
        assert got["c", c.name].error_msg == "no" and got["c", c.name].size is None


def test_squares_are_cut_from_rasters_dealt_once(spark):
    px = pixels(spark, 32, (40, 32, 1))
    cut = images.square_pictures(px)
    assert plan(cut).count("Exchange hashpartitioning") == 1
    want = {(r.img_id, r.pos): (r.x, r.y, r.r, r.g, r.b) for r in tables.tiles(px).collect()}
    got = {(r.img_id, r.pos): (r.x, r.y, r.r, r.g, r.b) for r in images.image_pixels(cut, "img_id").collect()}
    assert got == want


def test_channels_of_saved_pictures(spark, tmp_path):
    cut = images.square_pictures(pixels(spark, 32, (32, 32, 32)))
    images.save_pictures(cut, str(tmp_path), channels=F.when(F.col("img_id") == 0, "r").otherwise("rgbb"))
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    want = {r.img_id: bytes(r.bgr) for r in cut.collect()}
    assert got["0.png"].channels == 1 and bytes(got["0.png"].bgr) == want[0][2::3]
    assert got["65536.png"].channels == 4 and np.frombuffer(got["65536.png"].bgr, np.uint8).reshape(-1, 4)[:, :3].tobytes() == want[65536]


def test_runs_of_a_stretch_are_those_of_its_points():
    points = np.random.default_rng(5).integers(0, 40, (900, 3))
    whole, parts = MeanRuns(20.0), MeanRuns(20.0)
    assert parts.stretch(points[:311]) + parts.stretch(points[311:]) + parts.rest() == whole.runs(map(tuple, points.tolist()))
