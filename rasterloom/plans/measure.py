"""Encode, decode, compare, report: one plan over all images of a table or of files."""

from __future__ import annotations

import argparse
import os
import sys
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import RGB
from rasterloom.operators.fold import folded
from rasterloom.operators.metrics import ratio_ref, ratio_true
from rasterloom.plans.codecs import Codec, Given, Measured, measured_pictures
from rasterloom.sources.images import save_pictures
from rasterloom.sources.reports import display_name
from rasterloom.sources.shared import discard, written

RESULT = ["codec", "name", "compressed_size", "compression_ratio", "ratio_true", "error", "error_msg"]


def measure(px: DataFrame, codec: Codec, names: DataFrame | None = None, save: str | None = None) -> DataFrame:
    """A row for each image: codec, name, compressed_size, compression_ratio, ratio_true, error, error_msg.

    An image that fails, or that a lossless codec does not give back, keeps its row and says why. A codec of clusters adds
    `converged`. names: img_id and name; ids are names otherwise. save: a folder for decoded pictures whose error is not
    zero, and only for those; they are named by the base name of name, with the id where two share one.
    A picture is encoded, decoded and compared in one task, from one exchange of its pixels; the bytes of codecs that are
    plans over all images come to its pixels. The tables that hold them meanwhile are deleted."""
    made, rows = [], None
    if codec.by_image:
        rows = measured(px, [codec], save=bool(save))
    else:
        px = written(px.select("img_id", "pos", "x", "y", *RGB), "pixels")
        encoded = written(codec.encode(px), "encoded")
        made = [px, encoded]
        before = encoded.filter("encoded IS NOT NULL").select("img_id", F.lit(-1).cast("long").alias("pos"), *[F.lit(0).alias(c) for c in RGB], "encoded")
        both = px.select("img_id", "pos", *RGB, F.lit(None).cast("binary").alias("encoded")).unionByName(before)
        error = folded(both, "img_id", "pos", [*RGB, "encoded"], lambda: Given(codec), "error double, size_ok boolean")
        why = F.when(F.col("error_msg").isNotNull(), F.col("error_msg")).when(~F.col("size_ok"), "decoded size differs").when(F.lit(codec.is_lossless) & (F.col("error") != 0), "decoded image doesn't match")
        rows = encoded.join(error, "img_id", "left").withColumn("error_msg", why).withColumn("codec", F.lit(codec.name)).withColumn("size", F.octet_length("encoded").cast("long"))
    name = F.col("img_id").cast("string")
    result = _reported(rows.join(names, "img_id") if names is not None else rows.withColumn("name", name), codec, save)
    discard(*made)
    return result


def measure_pictures(pictures: DataFrame, codec: Codec, save: str | None = None) -> DataFrame:
    """The same of pictures that are a row each (img_id, name, w, h, channels, bgr, error_msg), of which each is encoded, decoded and
    compared where it is; those that have an error_msg keep it."""
    return _reported(measured_pictures(pictures, [codec], save=bool(save)), codec, save)


def _reported(rows: DataFrame, codec: Codec, save: str | None) -> DataFrame:
    ended = [c for c in rows.columns if c == "converged"]
    kept = ["encoded"] if save else []
    size = F.col("size")
    out = rows.select("img_id", "name", "codec", size.alias("compressed_size"), ratio_ref(size, F.col("w"), F.col("h")).alias("compression_ratio"), ratio_true(size, F.col("w"), F.col("h")).alias("ratio_true"), "error", "error_msg", *ended, *kept)
    result = written(out.select("img_id", *RESULT, *ended, *kept), "results")
    if save:
        base = display_name(F.col("name"))
        twin = F.count("*").over(Window.partitionBy("base")) > 1
        wrong = result.filter("error != 0").select("img_id", "encoded", base.alias("base")).withColumn("file", F.when(twin, F.concat_ws("-", "base", F.hex("img_id"))).otherwise(F.col("base")))
        save_pictures(codec.pictures(wrong, "file"), save, key="file")
    return result.drop("img_id", *kept)


def measured(px: DataFrame, codecs: list[Codec], save: bool = False) -> DataFrame:
    """img_id, codec, w, h, size, encoded, error, error_msg: a row for each image and codec, from one exchange of the pixels."""
    return folded(px, "img_id", "pos", ["x", "y", *RGB], lambda: Measured(codecs, save), Measured.SCHEMA)


@contextmanager
def timed(what: str):
    began = time.perf_counter()
    yield
    print(f"{what}: {time.perf_counter() - began:.3f} s")


def measure_files(spark: SparkSession, paths: list[str], codec: Codec, save: str | None = None) -> DataFrame:
    """The same over image files; those that can't be decoded have only a name and a message. Keyed by full path."""
    from rasterloom.sources.images import image_pixels, read_images

    found = read_images(spark, paths).withColumn("img_id", F.xxhash64("path"))
    if codec.by_image:
        return measure_pictures(found.withColumn("name", F.col("path")), codec, save)
    px = image_pixels(found, "img_id")
    good = measure(px, codec, found.select("img_id", F.col("path").alias("name")), save)
    bad = found.filter("error_msg IS NOT NULL").select(F.lit(codec.name).alias("codec"), F.col("path").alias("name"), "error_msg")
    return good.unionByName(bad, allowMissingColumns=True)


def scan_export(px: DataFrame, dims: DataFrame, kind: str) -> DataFrame:
    """Pixels in the order of the rect, small or large curve."""
    from rasterloom.operators import scan

    return {"rect": scan.hilbert_rect, "small": scan.hilbert_small, "large": scan.hilbert_large}[kind](px, dims)


def main(args: list[str] | None = None) -> None:
    """--codec=<spec> files..., or --special=hilbert files...

    Results of a codec go to <output>/<codec>.csv, files that failed to <output>/<codec>.failed.csv and, a line each, to
    standard error; decoded pictures that differ from theirs go to <output>/<codec>.pictures."""
    from rasterloom.plans.spec import parse
    from rasterloom.sources.images import image_pixels, read_images
    from rasterloom.sources.reports import under_output, write_failures, write_results, write_scan
    from rasterloom.sources.tables import images

    p = argparse.ArgumentParser(prog="rasterloom", description=main.__doc__)
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--codec")
    what.add_argument("--special", choices=["hilbert"])
    p.add_argument("--output", default="output")
    p.add_argument("files", nargs="+")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    if a.codec:
        codec = parse(a.codec)
        with timed(codec.name):
            results = written(measure_files(spark, a.files, codec, save=os.path.abspath(f"{a.output}/{codec.name}.pictures") if "://" not in a.output else f"{a.output}/{codec.name}.pictures"), "results")
        write_results(results.filter("error_msg IS NULL"), f"{a.output}/{codec.name}.csv")
        failed = results.filter("error_msg IS NOT NULL").select("name", "error_msg")
        write_failures(failed, f"{a.output}/{codec.name}.failed.csv")
        for r in failed.orderBy("name").toLocalIterator():
            print(f"{r.name}: {r.error_msg}", file=sys.stderr)
        discard(results)
        return
    found = read_images(spark, a.files).withColumn("img_id", under_output(F.col("path"), "hilbert.csv"))
    px = written(image_pixels(found, "img_id"), "pixels")
    for kind in ("rect", "small", "large"):
        write_scan(scan_export(px, images(px), kind), f"{a.output}/{kind}.hilbert.csv")
    discard(px)
    for r in found.filter("error_msg IS NOT NULL").select("path", "error_msg").orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.error_msg}", file=sys.stderr)


if __name__ == "__main__":
    main()
