"""Encoding, decoding and comparing in one pass over the pixels, and squares made without a join."""

import gc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import metrics
from rasterloom.plans import codecs
from rasterloom.plans.measure import measure, measured
from rasterloom.plans.queries import coded_texts
from rasterloom.sources.images import image_pixels
from rasterloom.sources.tables import tiles

SCHEMA = "img_id long, pos long, x int, y int, r int, g int, b int"


def pixels(spark, width=5, heights=(4, 3, 1)):
    r = np.random.default_rng(3)
    rows = [(i, p, p % width, p // width, *r.integers(0, 4, 3).tolist()) for i, h in enumerate(heights) for p in range(width * h)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_codecs_of_a_picture_from_one_exchange(spark):
    kinds = [codecs.Hufman(), codecs.Delta(), codecs.HilbertRle(), codecs.HilbertZip(), codecs.ZipDict(), codecs.ZipBack(), codecs.Plain(), codecs.HilbertRle(2.0)]
    px = pixels(spark)
    both = measured(px, kinds)
    assert plan(both).count("Exchange hashpartitioning") == 1
    got = {(r.img_id, r.codec): r for r in both.collect()}
    assert len(got) == 3 * len(kinds)
    for c in kinds:
        encoded = c.encode(px)
        sizes = {r.img_id: len(r.encoded) for r in encoded.collect()}
        errors = {r.img_id: r.error for r in metrics.mse(px, c.decode(encoded)).collect()}
        for i in range(3):
            r = got[i, c.name]
            assert (r.size, r.error, r.error_msg) == (sizes[i], pytest.approx(errors[i]), None)


class Wrong(codecs.Plain):
    name = "wrong"

    def decode_image(self, data):
        w, h, rgb = super().decode_image(data)
        if h == 1:
            raise ValueError("broken")
        return (w, h - 1, rgb[: w * (h - 1)]) if h == 3 else (w, h, rgb + 1)


def test_pictures_that_are_not_given_back_say_so(spark):
    got = {r.name: (r.error, r.error_msg) for r in measure(pixels(spark), Wrong()).collect()}
    assert got == {"0": (3.0, "decoded image doesn't match"), "1": (0.0, "decoded size differs"), "2": (0.0, "ValueError: broken")}


@pytest.mark.parametrize("codec", [codecs.ClusterColours(3), codecs.Voronoi(3)])
def test_codecs_of_clusters_are_compared_with_their_pixels(spark, codec):
    px = pixels(spark)
    want = {str(r.img_id): r.error for r in metrics.mse(px, codec.decode(codec.encode(px))).collect()}
    assert {r.name: r.error for r in measure(px, codec).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_squares_need_no_join(spark):
    px = pixels(spark, 32, (40, 32, 1))
    squares = tiles(px)
    assert "Join" not in plan(squares)
    want = {(r.img_id * 65536 + r.pos // 1024, r.pos % 1024): (r.r, r.g, r.b) for r in px.collect()}
    got = {(r.img_id, r.pos): (r.r, r.g, r.b) for r in squares.collect()}
    assert len(got) == 4 * 1024 == squares.count() and {k: got[k] for k in want} == want
    assert {v for k, v in got.items() if k not in want} == {(0, 0, 0)}


def test_no_pixel_of_a_picture_file_carries_the_file(spark):
    rows = [("a", 2, 1, 1, bytes([7, 9]), None), ("b", 1, 2, 4, bytes([1, 2, 3, 9, 4, 5, 6, 9]), None), ("c", None, None, None, None, "no")]
    got = image_pixels(spark.createDataFrame(rows, "path string, w int, h int, channels int, bgr binary, error_msg string"))
    assert "Generate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, 0, 7, 7, 7), ("a", 1, 1, 0, 9, 9, 9), ("b", 0, 0, 0, 3, 2, 1), ("b", 1, 0, 1, 6, 5, 4)]


class Held:
    alive = most = 0

    def __init__(self):
        Held.alive += 1
        Held.most = max(Held.most, Held.alive)

    def __del__(self):
        Held.alive -= 1


def test_symbols_of_one_text_at_a_time(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def one(data: bytes) -> tuple:
        held = Held()
        gc.disable()
        return len(data), type(held).most

    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("ab"), (F.col("id") % 9).cast("int"))).cast("binary").alias("data"))
    got = coded_texts(rows.select("doc_id", F.coalesce("data", F.lit(b"")).alias("data")).coalesce(1), one, "n long, most long").collect()
    assert len(got) == 1000 and {r.most for r in got} == {1}
    assert all(r.n == (2 * (r.doc_id % 9) if r.doc_id % 7 else 0) for r in got)
