"""Folds that carry their state from batch to batch, and the table of codes."""

import random

import numpy as np
import pytest

from rasterloom.operators import huffman, sequence
from rasterloom.plans import codecs


@pytest.fixture()
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def table(spark, rows):
    return spark.createDataFrame(rows, "img_id long, pos long, x int, y int, r int, g int, b int").repartition(3)


def pictures():
    r = random.Random(8)
    rows = []
    for img, (w, h), most in ((1, (9, 7), 3), (2, (8, 8), 1), (5, (1, 1), 200), (7, (40, 13), 2), (None, (3, 2), 9)):
        rows += [(img, p, p % w, p // w, r.randint(0, most), 3, r.randint(0, most)) for p in range(w * h)]
    return rows


def test_runs_and_means_across_batches(spark, small_batches):
    rows = pictures()
    px = table(spark, rows)
    runs, means = {}, {}
    for r in sequence.mean_runs(px, 1.0).collect():
        runs.setdefault(r.img_id, {})[r.seq] = (r.cnt, [r.r, r.g, r.b])
    for r in sequence.running_means(px, 1.0).collect():
        means.setdefault(r.img_id, {})[r.pos] = (r.run, r.n, r.mr, r.mg, r.mb)
    for img in {r[0] for r in rows}:
        points = [r[4:] for r in sorted((r for r in rows if r[0] == img), key=lambda r: r[1])]
        want = sequence.MeanRuns(1.0).runs(points)
        assert [runs[img][i] for i in range(len(runs[img]))] == want
        at = 0
        for k, (n, _) in enumerate(want):
            for j in range(n):
                mean = np.mean(points[at : at + j + 1], axis=0)
                assert means[img][at + j][:2] == (k, j + 1) and np.allclose(means[img][at + j][2:], mean)
            at += n
    assert sequence.mean_runs(px.limit(0), 1.0).collect() == []


@pytest.mark.parametrize("codec", [codecs.Hufman(), codecs.Delta(), codecs.HilbertRle(), codecs.HilbertRle(2.0), codecs.ZipDict()])
def test_codecs_across_batches(spark, small_batches, codec):
    """Bytes do not depend on batches: those of each picture as a whole."""
    rows = [r for r in pictures() if r[0] is not None]
    got = {r.img_id: r for r in codec.encode(table(spark, rows)).collect()}
    for img in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == img), key=lambda r: r[1])
        w, h = max(r[2] for r in own) + 1, max(r[3] for r in own) + 1
        rgb = np.array([r[4:] for r in own])
        if isinstance(codec, codecs.HilbertRle):
            scanned = codecs._along(w, h, rgb)
            points = list(map(tuple, scanned.tolist()))
            runs = sequence.MeanRuns(codec.allowance).runs(points)
            want = codecs.header(w, h) + b"".join(bytes([n, 3, 0, 0, 0, 0, 0, 0, 0, *c]) for n, c in runs)
        else:
            want = codec.encode_image(w, h, rgb)
        assert (got[img].w, got[img].h, bytes(got[img].encoded), got[img].error_msg) == (w, h, want, None)
    back = {(r.img_id, r.pos): (r.x, r.y, r.r, r.g, r.b) for r in codec.decode(codec.encode(table(spark, rows))).collect()}
    if codec.is_lossless:
        assert back == {r[:2]: r[2:] for r in rows}
    assert len(back) == len(rows)


def test_equal_runs_across_stretches():
    r = random.Random(1)
    for _ in range(200):
        points = np.array([[r.randint(0, 1), 0] for _ in range(r.randint(1, 60))])
        cap = r.choice([1, 2, 3, 255])
        state, got = sequence.EqualRuns(cap), []
        for part in np.array_split(points, r.randint(1, 5)):
            if len(part):
                got += state.stretch(part)
        assert got + state.rest() == sequence.MeanRuns(0.0, 2, cap).runs(map(tuple, points.tolist()))


def test_a_picture_that_cannot_be_coded_says_so(spark):
    rows = [(1, 0, 0, 0, 1, 2, 3), (1, 1, 1, 0, 900, 2, 3), (2, 0, 0, 0, 1, 2, 3)]
    got = {r.img_id: r for r in codecs.Hufman().encode(table(spark, rows)).collect()}
    assert got[1].encoded is None and got[1].error_msg and got[2].error_msg is None


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_table_of_codes(monkeypatch, stretch):
    monkeypatch.setattr(huffman, "STRETCH", stretch)
    r = random.Random(stretch)
    for _ in range(60):
        n = r.randint(1, 300)
        symbols = [tuple(int(r.expovariate(0.7)) for _ in range(3)) for _ in range(n)]
        data = huffman.encode_all(symbols, huffman.RGB)
        assert huffman.decode_all(b"junk" + data, 4, n, huffman.RGB) == symbols
        assert huffman.decode_array(data, 0, n, huffman.RGB).tolist() == list(map(list, symbols))
        if len(set(symbols)) > 1:
            with pytest.raises(ValueError):
                huffman.decode_all(data, 0, n + 8, huffman.RGB)


def test_table_refuses_deep_trees():
    node = 0
    for i in range(1, 70):
        node = huffman.Branch(i, node)
    with pytest.raises(ValueError, match="64 bits"):
        huffman.Table(node)
