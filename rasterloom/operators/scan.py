"""Orders in which the pixels of an image are visited."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rasterloom.functions.scalar import hilbert_index, large_side, small_side


def raster_order(px: DataFrame) -> DataFrame:
    return px.withColumn("hidx", F.col("pos"))


def hilbert_small(px: DataFrame, dims: DataFrame) -> DataFrame:
    """The square at the origin whose side is half the next power of two of the shorter edge."""
    side = small_side(F.col("w"), F.col("h"))
    return px.join(dims.select("img_id", side.alias("side")), "img_id").filter("x < side AND y < side").withColumn("hidx", hilbert_index(F.col("x"), F.col("y"), F.col("side"))).drop("side")


def hilbert_large(px: DataFrame, dims: DataFrame) -> DataFrame:
    """All pixels, by the curve of the smallest square of a power of two around the image; hidx has gaps."""
    side = large_side(F.col("w"), F.col("h"))
    return px.join(dims.select("img_id", side.alias("side")), "img_id").withColumn("hidx", hilbert_index(F.col("x"), F.col("y"), F.col("side"))).drop("side")


def square_places(x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places along the Hilbert curve of squares whose side is a power of two, a quadrant at a time."""
    x, y, s = x.astype(np.int64), y.astype(np.int64), np.asarray(side, np.int64) // 2
    out = np.zeros(len(x), np.int64)
    while (s > 0).any():
        right, down = x >= s, y >= s
        out += np.where(right, np.where(down, 2, 3), np.where(down, 1, 0)) * s * s
        x, y = np.where(right, np.where(down, x - s, s - 1 - y), np.where(down, x, y)), np.where(right, np.where(down, y - s, 2 * s - 1 - x), np.where(down, y - s, x))
        s = s // 2
    return out


def rect_places(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of cells along a generalised Hilbert curve of w x h rectangles, each found by descent.

    A part of the curve covers n cells along one direction and m along another. It is halved along its longer edge, or, if
    that is not much longer, cut in three turned parts; a part of one row or column is a line. A cell follows the part
    that holds it and skips the cells of the parts before, so the work is of the order of the logarithm of the sides and
    nothing is as large as a picture. This is the generalised Hilbert curve of Jakub Cerveny's gilbert (2018); its
    licence (BSD 2-Clause) is in NOTICE. Squares of a power of two follow the Hilbert curve's quadrants."""
    x, y, w, h = (np.broadcast_to(np.asarray(v, np.int64), np.shape(x)).copy() for v in (x, y, w, h))
    out = np.zeros(len(x), np.int64)
    exact = (w == h) & (w & (w - 1) == 0)
    out[exact] = square_places(x[exact], y[exact], w[exact])
    rows = np.flatnonzero(~exact)
    x, y, w, h = x[rows], y[rows], w[rows], h[rows]
    wide = w >= h
    n, m = np.where(wide, w, h), np.where(wide, h, w)
    # u and v: how far the cell lies along the two directions of its part, which are signed turns of the axes
    u, v = np.where(wide, x, y), np.where(wide, y, x)
    while len(rows):
        line = (n == 1) | (m == 1)
        out[rows[line]] += np.where(m[line] == 1, u[line], v[line])
        rows, n, m, u, v = (a[~line] for a in (rows, n, m, u, v))
        halved = 2 * n > 3 * m
        n2, m2 = n // 2, m // 2
        n2 += halved & (n2 % 2 == 1) & (n > 2)
        m2 += ~halved & (m2 % 2 == 1) & (m > 2)
        far, high = u >= n2, v >= m2
        last = ~halved & ~high & far
        out[rows] += np.where(halved, np.where(far, n2 * m, 0), np.where(high, n2 * m2, np.where(far, n2 * m2 + n * (m - m2), 0)))
        # of a halved part one side; else a turned corner, the side opposite, or the other corner from its end
        n, m, u, v = (
            np.where(halved, np.where(far, n - n2, n2), np.where(high, n, m2)),
            np.where(halved, m, np.where(high, m - m2, np.where(far, n - n2, n2))),
            np.where(halved, np.where(far, u - n2, u), np.where(high, u, np.where(last, m2 - 1 - v, v))),
            np.where(halved, v, np.where(high, v - m2, np.where(last, n - 1 - u, u))),
        )
    return out


@F.pandas_udf(LongType())
def _place(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series(rect_places(x.to_numpy(), y.to_numpy(), w.to_numpy(), h.to_numpy()))


def hilbert_rect(px: DataFrame, dims: DataFrame) -> DataFrame:
    """All pixels along a curve made for the image's own width and height, without gaps."""
    return px.join(dims.select("img_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")), "img_id").withColumn("hidx", _place("x", "y", "w", "h")).drop("w", "h")


def on_curve(px: DataFrame) -> DataFrame:
    """The same with sizes taken from the pixels, which are read once and dealt by image."""
    image = Window.partitionBy("img_id")
    sized = px.select("*", (F.max("x").over(image) + 1).alias("_w"), (F.max("y").over(image) + 1).alias("_h"))
    return sized.withColumn("hidx", _place("x", "y", "_w", "_h")).drop("_w", "_h")


class Along:
    """A fold that gathers an image's x, y and values in raster order and gives what `made` makes of the values along the curve.
    A plan by on_curve() deals all pixels out a second time, for what a Python function gives has no known distribution."""

    def __init__(self, made: Callable[[np.ndarray], list]):
        self.made, self.parts = made, []

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> None:
        self.parts.append(np.stack(values, 1))

    def end(self) -> list:
        px = np.concatenate(self.parts).astype(np.int64)
        x, y = px[:, 0], px[:, 1]
        return self.made(px[np.argsort(rect_places(x, y, x.max() + 1, y.max() + 1), kind="stable"), 2:])


def coordinates(dims: DataFrame) -> DataFrame:
    """img_id, x, y of every cell, with hidx, for decoders."""
    cells = dims.select("img_id", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("pos"), "w")
    cells = cells.select("img_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") % F.col("w")).cast("int").alias("x"), F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"))
    return hilbert_rect(cells, dims)
