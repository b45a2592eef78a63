"""Sizes, ratios, errors and the aggregates behind report plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import RGB, square_sum


def raw_size(w: Column, h: Column) -> Column:
    return w.cast("long") * h.cast("long") * 24


def ratio_ref(size: Column, w: Column, h: Column) -> Column:
    """Percent of 24 a pixel, which are bits: an eighth of the ratio in bytes. Kept so that reports compare."""
    return size.cast("double") / raw_size(w, h) * 100


def ratio_true(size: Column, w: Column, h: Column) -> Column:
    return size.cast("double") / (w.cast("long") * h.cast("long") * 3) * 100


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """img_id, error: squared channel differences summed over the pixels that both have, over the larger pixel count;
    size_ok tells whether the counts agree."""
    left = a.select("img_id", "pos", *[F.col(c).alias(f"a{c}") for c in RGB])
    right = b.select("img_id", "pos", *[F.col(c).alias(f"b{c}") for c in RGB])
    both = left.join(right, ["img_id", "pos"], "full")
    d2 = square_sum([F.col(f"a{c}") for c in RGB], [F.col(f"b{c}") for c in RGB])
    return both.groupBy("img_id").agg((F.coalesce(F.sum(d2), F.lit(0)) / F.greatest(F.count("ar"), F.count("br"))).alias("error"), (F.count("ar") == F.count("br")).alias("size_ok"))


def boxplot(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles, mean, and whiskers: the furthest values within 1.5 interquartile ranges of the box."""
    box = rows.groupBy(*group).agg(F.expr(f"percentile({value}, 0.25)").alias("q1"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.75)").alias("q3"), F.avg(value).alias("mean"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(box, group).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy(*group).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi"))
    return box.join(ends, group)


def lossless_only(results: DataFrame, group: str = "display_name") -> DataFrame:
    """Result rows of groups without an error, or whose mean error is 0."""
    good = results.groupBy(group).agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("e")).filter("e = 0").select(group)
    return results.join(good, group, "left_semi")


def dims_histogram(images: DataFrame) -> DataFrame:
    return images.groupBy(F.concat_ws("x", "w", "h").alias("dims")).agg(F.count("*").alias("cnt"))


def bundled(dims: DataFrame) -> DataFrame:
    """Dimensions by falling count, those that occur once together as `singles`, if any."""
    return dims.groupBy(F.when(F.col("cnt") == 1, "singles").otherwise(F.col("dims")).alias("dims")).agg(F.sum("cnt").alias("cnt")).orderBy((F.col("dims") == "singles"), F.desc("cnt"), "dims")


def subpixel_histogram(px: DataFrame) -> DataFrame:
    return px.select("img_id", F.explode(F.array(*RGB)).alias("level")).groupBy("img_id", "level").agg(F.count("*").alias("cnt"))


def n_colours(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(F.countDistinct(*RGB).alias("ncolors"))
