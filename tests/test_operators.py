import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalar as fn
from rasterloom.operators import joins, kmeans, metrics, sequence
from rasterloom.plans import codecs
from rasterloom.plans.measure import measure, measure_files
from rasterloom.plans.spec import parse
from rasterloom.sources import reports
from rasterloom.sources.images import image_pixels, png, read_images

SCAN = [3, 3, 5, 7, 6, 6, 8, 8, 7, 7, 7, 8, 9, 9, 8, 9]


def _pixels(spark, rows, w=4, img=0):
    return spark.createDataFrame([(img, i, i % w, i // w, *c) for i, c in enumerate(rows)], codecs.PIXELS)


def test_runs_and_back(spark):
    px = _pixels(spark, [(v, 0, 0) for v in SCAN])
    rle = sequence.runs(px, ["img_id"], "pos")
    assert [(r.cnt, r.r) for r in rle.orderBy("seq").collect()] == [(2, 3), (1, 5), (1, 7), (2, 6), (2, 8), (3, 7), (1, 8), (2, 9), (1, 8), (1, 9)]
    assert [r.r for r in sequence.expand_runs(rle, ["img_id"]).orderBy("pos").collect()] == SCAN


def test_runs_are_cut_at_255(spark):
    px = _pixels(spark, [(1, 1, 1)] * 520 + [(2, 2, 2)] * 10 + [(1, 1, 1)] * 80, 10)
    assert [r.cnt for r in sequence.runs(px, ["img_id"], "pos").orderBy("seq").collect()] == [255, 255, 10, 10, 80]


def test_delta_and_back(spark):
    px = _pixels(spark, [(v, v, 255 - v) for v in SCAN])
    d = sequence.delta(px, ["img_id"], "pos")
    assert [r.dr for r in d.orderBy("pos").collect()] == [3, 0, 2, 2, -1, 0, 2, 0, -1, 0, 0, 1, 1, 0, -1, 1]
    assert [r.r for r in sequence.undelta(d, ["img_id"], "pos").orderBy("pos").collect()] == SCAN


def test_unsigned_raises(spark):
    with pytest.raises(Exception, match="not a byte"):
        spark.range(1).select(fn.unsigned(F.col("id") - 1)).collect()


def _points(spark, xy):
    return spark.createDataFrame([(0, i, x, y, 1) for i, (x, y) in enumerate(xy)], "img_id long, pos long, x int, y int, cnt int")


def test_kmeans(spark):
    square = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    _, c = kmeans.kmeans(_points(spark, square), 1, ["x", "y"])
    assert [(r.x, r.y) for r in c.collect()] == [(0, 0)]
    two = [(x - 100, y) for x, y in square] + [(x + 100, y) for x, y in square]
    _, c = kmeans.kmeans(_points(spark, two), 2, ["x", "y"])
    assert sorted((r.x, r.y) for r in c.collect()) == [(-100, 0), (100, 0)]
    _, c = kmeans.kmeans(_points(spark, [(0, 0), (1, 1), (2, 2), (3, 3)]), 3, ["x", "y"])
    assert c.count() == 3 and c.filter("NOT converged").count() == 0
    with pytest.raises(Exception, match="fewer points"):
        kmeans.kmeans(_points(spark, [(0, 0)]), 2, ["x", "y"])[1].collect()


def test_certainty_radius(spark):
    c = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 5, 5)], "img_id long, cid int, x int, y int")
    got = joins.certainty_radius(joins.centroid_pairs(c, ["x", "y"]), c).collect()
    assert sorted((r.img_id, r.radius) for r in got) == [(0, 0.5), (0, 0.5), (1, float("inf"))]


def test_wire_and_bits(spark):
    row = spark.range(1).select(fn.le(F.lit(-2), 2), fn.from_le(fn.le(F.lit(-2), 2), 2, True), fn.pack_bits(F.lit("010111100000110")), fn.unpack_bits(F.unhex(F.lit("0df0"))), fn.byte_from_bits(F.lit("0101")), fn.bit_mask(F.lit(9)), fn.bit_string(F.lit(0b10110010), False)).first()
    assert list(row) == [b"\xfe\xff", -2, b"\x5e\x0c", "0000110111110000", None, 255, "01001101"]


@pytest.mark.parametrize("spec", ["hufman", "delta", "hilbert(rle)", "hilbert(zip)", "zip(dict)", "zip(back)", "hilbert(rle(8))", "cluster-colors(2)", "voronoi(2)"])
def test_measure(spark, spec):
    flat = _pixels(spark, [(9, 9, 9)] * 29 + [(8, 9, 9)], 5)
    mixed = _pixels(spark, [(i * 7 % 251, i % 3, 255 - i) for i in range(35)], 5, 1)
    codec = parse(spec)
    rows = measure(flat.union(mixed), codec).collect()
    assert len(rows) == 2
    assert all(r.error_msg is None for r in rows)
    if codec.is_lossless:
        assert all(r.error == 0 for r in rows)
    assert all(abs(r.ratio_true - 8 * r.compression_ratio) < 1e-9 for r in rows)


def test_files(spark, tmp_path):
    pixels = [(i % 256, (3 * i) % 256, 7) for i in range(12)]
    (tmp_path / "a.png").write_bytes(png(4, 3, bytes(v for p in pixels for v in p)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    found = read_images(spark, str(tmp_path), "*.png")
    assert found.filter("error_msg IS NOT NULL").count() == 1
    got = image_pixels(found).orderBy("pos").collect()
    assert [(r.r, r.g, r.b) for r in got] == pixels
    rows = measure_files(spark, [str(tmp_path)], codecs.Hufman()).collect()
    assert sorted((r.name.rsplit("/", 1)[-1], r.error_msg is None) for r in rows) == [("a.png", True), ("bad.png", False)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.png", 10, 1.5, 0.0), ("c.png", 20, 2.5, 0.0)], reports.RESULTS)
    reports.write_results(rows, f"{tmp_path}/delta.csv")
    reports.write_results(rows, f"{tmp_path}/x.rect.hilbert.csv")
    got = reports.read_results(spark, str(tmp_path)).collect()
    assert {r.display_name for r in got} == {"delta"} and len(got) == 2


def test_mse_sees_missing_pixels(spark):
    a, b = _pixels(spark, [(1, 1, 1)] * 8), _pixels(spark, [(1, 1, 3)] * 4)
    row = metrics.mse(a, b).first()
    assert (row.error, row.size_ok) == (2.0, False)


def test_ring_places_and_distances_are_inverse(spark):
    from rasterloom.functions import scalar as fn

    rows = spark.createDataFrame([(w, p) for w in (0, 3, 10, 27) for p in range(10)], "written long, place long")
    d = fn.ring_distance(F.col("place"), F.col("written"), 10)
    for r in rows.select("*", d.alias("d"), fn.ring_place(d, F.col("written"), 10).alias("back")).collect():
        assert r.back == r.place and 1 <= r.d <= 10 and (r.written - r.d) % 10 == r.place


def test_ngram_matches_by_stretches(spark, monkeypatch):
    """The oldest match within the window, the same whether a text is one stretch or many."""
    import random

    from rasterloom.operators import joins

    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(400)), b"", b"abc", b"a" * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, data binary")
    want = set()
    for i, t in enumerate(texts):
        for pos in range(len(t) - 5):
            prev = [p for p in range(max(0, pos - 50), pos) if t[p : p + 6] == t[pos : pos + 6]]
            want |= {(i, pos, prev[0])} if prev else set()
    monkeypatch.setattr(joins, "STRETCH", 64)
    assert {tuple(x) for x in joins.ngram_matches(rows, 6, 50).collect()} == want


def test_byte_sizes_of_empty_and_single(spark):
    from rasterloom.operators import huffman

    rows = spark.createDataFrame([(0, b""), (1, b"aaaa"), (2, b"aab")], "doc_id long, data binary")
    got = {r.doc_id: (r.n, r.payload_bits, r.size, r.kraft) for r in huffman.byte_sizes(rows).collect()}
    assert got == {0: (0, 0, 8, 0.0), 1: (1, 0, 10, 1.0), 2: (2, 3, 14, 1.0)}


def test_command_line(spark, tmp_path, capsys):
    """Pictures named on the command line to a report, and to scan exports."""
    from rasterloom.plans import measure
    from rasterloom.sources import reports
    from rasterloom.sources.images import png

    (tmp_path / "a.png").write_bytes(png(4, 4, bytes(48)))
    measure.main([f"--output={tmp_path}/out", "--codec=hilbert(rle)", f"{tmp_path}/a.png"])
    assert [(r.compressed_size, r.error, r.display_name) for r in reports.read_results(spark, f"{tmp_path}/out").collect()] == [(20, 0.0, "hilbert-rle")]
    assert "hilbert-rle" in capsys.readouterr().out
    measure.main([f"--output={tmp_path}/scans", "--special=hilbert", f"{tmp_path}/*.png"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/scans/rect.hilbert.csv").count() == 16


def test_readable_sizes(spark):
    cases = {0: "0 B", 215: "215 B", 999: "999 B", 1000: "1.0 KB", 1050: "1.1 KB", 1049: "1.0 KB", 301_000: "301.0 KB", 419_000_000: "419.0 MB", 10**18: "1.0 EB", 2**63 - 1: "9.2 EB", 999_949: "999.9 KB", None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "n long, text string")
    assert rows.filter(~fn.human_bytes(F.col("n")).eqNullSafe(F.col("text"))).count() == 0
