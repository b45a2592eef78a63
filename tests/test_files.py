"""Whole files as a data source, and what the command line saves and says."""

import os

import pytest

from rasterloom.plans import codecs, measure
from rasterloom.sources import files, images, reports


def rows(spark, found):
    return spark.createDataFrame(found, "name string, content binary")


def held(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith("."))


def test_written_and_read(spark, tmp_path):
    top = f"{tmp_path}/new/top"
    content = {f"d{i % 3}/{i}.bin": os.urandom(i * 10) for i in range(20)}
    files.write_files(rows(spark, list(content.items())).repartition(4), top)
    assert held(top) == sorted(content)
    got = files.read_files(spark, top)
    assert {r.name: bytes(r.content) for r in got.collect()} == content and all(r.file_size == len(r.content) for r in got.collect())
    assert files.read_files(spark, top, "1*.bin").count() == 11
    small = spark.read.format("whole_files").option("path", top).option("portion", "100").load()
    assert small.rdd.getNumPartitions() > 10 and small.count() == 20


def test_append_and_overwrite(spark, tmp_path):
    files.write_files(rows(spark, [("a", b"1"), ("b", b"2")]), str(tmp_path))
    files.write_files(rows(spark, [("b", b"3"), ("c", b"4")]), str(tmp_path))
    assert {r.name: bytes(r.content) for r in files.read_files(spark, str(tmp_path)).collect()} == {"a": b"1", "b": b"3", "c": b"4"}
    files.write_files(rows(spark, [("c", b"5")]), str(tmp_path), "overwrite")
    assert held(tmp_path) == ["c"]
    files.write_files(rows(spark, []), str(tmp_path))
    assert held(tmp_path) == ["c"]


@pytest.mark.parametrize("bad, why", [(("../x", b""), "no name of a file"), (("_x", b""), "no name of a file"), (("a//b", b""), "no name of a file"), ((None, b""), "needs a name"), (("a", None), "needs a name"), (("ok7", b""), "came twice")])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad, why):
    (tmp_path / "old").write_bytes(b"kept")
    good = [(f"ok{i}", b"x" * 9) for i in range(30)]
    with pytest.raises(Exception, match=why):
        files.write_files(rows(spark, [*good, bad]).repartition(5), str(tmp_path))
    assert [n for n in held(tmp_path) if not n.startswith("_job-")] == ["old"]
    assert [r.name for r in files.read_files(spark, str(tmp_path)).collect()] == ["old"]


def test_empty_and_missing_folders(spark, tmp_path):
    assert files.read_files(spark, str(tmp_path)).count() == 0
    assert files.read_files(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="needs the option path"):
        spark.read.format("whole_files").load().count()


def picture(w, h, f):
    return images.png(w, h, bytes(v for p in range(w * h) for v in f(p)))


def test_pictures_are_saved_where_they_differ(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "flat.png").write_bytes(picture(8, 8, lambda p: (7, 7, 7)))
    (tmp_path / "in" / "noise.png").write_bytes(picture(8, 8, lambda p: (p * 37 % 256, p % 5, 200)))
    (tmp_path / "in" / "sub" / "noise.png").write_bytes(picture(4, 4, lambda p: (p, 3 * p, 0)))
    paths = [f"{tmp_path}/in/flat.png", f"{tmp_path}/in/noise.png", f"{tmp_path}/in/sub/noise.png"]
    codec = codecs.HilbertRle(60.0)
    got = {r.name: r for r in measure.measure_files(spark, paths, codec, save=f"{tmp_path}/out").collect()}
    assert got[paths[0]].error == 0 and got[paths[1]].error > 0 and got[paths[2]].error > 0
    saved = held(f"{tmp_path}/out")
    assert len(saved) == 2 and all(s.startswith("noise-") for s in saved)
    found = images.read_images(spark, f"{tmp_path}/out/*.png")
    assert sorted((r.w, r.h) for r in found.collect()) == [(4, 4), (8, 8)]
    measure.measure_files(spark, paths, codecs.HilbertRle(), save=f"{tmp_path}/none")
    assert not os.path.exists(f"{tmp_path}/none") or held(f"{tmp_path}/none") == []


def test_command_line_keeps_and_prints_failures(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(picture(4, 4, lambda p: (p, 0, p)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    measure.main([f"--output={tmp_path}/out", "--codec=hilbert(rle(40))", f"{tmp_path}/a.png", f"{tmp_path}/broken.png"])
    said = capsys.readouterr().err
    assert "broken.png: cannot be decoded" in said and "a.png" not in said
    name = codecs.HilbertRle(40.0).name
    assert [r.display_name for r in reports.read_results(spark, f"{tmp_path}/out").collect()] == [name]
    failed = spark.read.option("header", True).csv(f"{tmp_path}/out/{name}.failed.csv").collect()
    assert [(r.name.rsplit("/")[-1], r.error_msg) for r in failed] == [("broken.png", "cannot be decoded")]
    assert held(f"{tmp_path}/out/{name}.pictures") == ["a.png"]


def test_sizes_of_pictures(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(data := picture(6, 2, lambda p: (p, p, p)))
    (row,) = images.png_sizes(spark, str(tmp_path)).collect()
    assert row.compressed_size == len(data) and row.compression_ratio == pytest.approx(len(data) / (12 * 24) * 100)
