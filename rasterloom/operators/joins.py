"""Lookups and nearest-point joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import RGB, square_sum

#: Broadcasting centroids is for tables up to this many rows for an image; their number is a codec parameter, not data.
FEW = 4096
#: Bytes of a string whose n-grams are sorted at once.
STRETCH = 1 << 21


def recolour(px: DataFrame, palette: DataFrame) -> DataFrame:
    """px with the colours that palette (img_id, r, g, b, nr, ng, nb) has for them; a missing colour raises."""
    new = [F.coalesce(F.col(f"n{c}"), F.raise_error(F.lit("colour without a centroid")).cast("int")).alias(c) for c in RGB]
    return px.join(palette, ["img_id", *RGB], "left").select("img_id", "pos", "x", "y", *new)


def with_codes(symbols: DataFrame, codebook: DataFrame, by: list[str]) -> DataFrame:
    """Symbols with code and len; null where the codebook has no such symbol."""
    return symbols.join(codebook, by, "left")


def positional(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows side by side as far as both go."""
    return a.join(b, on)


def nearest(points: DataFrame, centroids: DataFrame, features: list[str], key: str = "img_id", point: str = "pos", current: str | None = None) -> DataFrame:
    """key, point, cid, d2: the nearest centroid; equal distances go to the current one, if any, then the lowest cid.

    For few centroids: a join on the image, whose pairs Catalyst reduces in the same stage."""
    c = centroids.select(key, F.col("cid").alias("_cid"), *[F.col(f).alias(f"_{f}") for f in features])
    d2 = square_sum([F.col(f) for f in features], [F.col(f"_{f}") for f in features])
    moved = (F.col("_cid") != F.col(current)).cast("int") if current else F.lit(0)
    pairs = points.join(c, key).select(key, point, F.struct(d2.alias("d2"), moved.alias("moved"), F.col("_cid").alias("cid")).alias("m"))
    return pairs.groupBy(key, point).agg(F.min("m").alias("m")).select(key, point, F.col("m.cid").alias("cid"), F.col("m.d2").alias("d2"))


def nearest_numpy(points: DataFrame, centroids: DataFrame, features: list[str], key: str = "img_id", point: str = "pos", current: str | None = None) -> DataFrame:
    """The same for many centroids: one image's centroids meet its points in blocks, and no pairs are made."""
    kinds = dict(points.dtypes)
    schema = f"{key} {kinds[key]}, {point} {kinds[point]}, cid int, d2 long"

    def find(pts: pd.DataFrame, cts: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(cts):
            return pd.DataFrame({key: [], point: [], "cid": [], "d2": []})
        cts = cts.sort_values("cid")
        c, ids = cts[features].to_numpy(np.int64), cts.cid.to_numpy()
        p = pts[features].to_numpy(np.int64)
        best, d2 = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
        step = max(1, 4_000_000 // len(c))
        for i in range(0, len(p), step):
            d = ((p[i : i + step, None, :] - c[None]) ** 2).sum(2)
            best[i : i + step], d2[i : i + step] = d.argmin(1), d.min(1)
        cid = ids[best]
        if current:
            own = pts[current].to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            stays = (ids[at] == own) & (((p - c[at]) ** 2).sum(1) == d2)
            cid = np.where(stays, own, cid)
        return pd.DataFrame({key: pts[key].to_numpy(), point: pts[point].to_numpy(), "cid": cid, "d2": d2})

    return points.groupBy(key).cogroup(centroids.groupBy(key)).applyInPandas(find, schema)


def centroid_pairs(centroids: DataFrame, features: list[str], key: str = "img_id") -> DataFrame:
    """key, src, dst, d2 of all pairs of an image's centroids; the pairs are the result, k * (k - 1) for k centroids."""
    a = centroids.select(key, F.col("cid").alias("src"), *features)
    b = centroids.select(key, F.col("cid").alias("dst"), *[F.col(f).alias(f"_{f}") for f in features])
    d2 = square_sum([F.col(f) for f in features], [F.col(f"_{f}") for f in features])
    return a.join(b, key).filter("src != dst").select(key, "src", "dst", d2.alias("d2"))


def neighbour_rank(pairs: DataFrame, key: str = "img_id", most: int | None = None) -> DataFrame:
    """Neighbours by distance, then id; only the first `most`, if given."""
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key, "src").orderBy("d2", "dst")))
    return ranked.filter(F.col("rank") <= most) if most else ranked


def certainty_radius(pairs: DataFrame, centroids: DataFrame, key: str = "img_id") -> DataFrame:
    """Half the distance to the closest other centroid, infinity without one."""
    near = pairs.groupBy(key, F.col("src").alias("cid")).agg((F.sqrt(F.min("d2").cast("double")) / 2).alias("r"))
    return centroids.select(key, "cid").join(near, [key, "cid"], "left").select(key, "cid", F.coalesce("r", F.lit(float("inf"))).alias("radius"))


def _oldest(data: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that have an earlier one within the window with the same n bytes, and the oldest such position."""
    count = len(data) - n + 1
    if count < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(count, np.uint64)
    for k in range(n):
        gram = gram << np.uint64(8) | data[k : k + count].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    group = np.cumsum(np.append(0, gram[order][1:] != gram[order][:-1]))
    at = group * np.int64(count + window) + order
    first = np.searchsorted(at, group * np.int64(count + window) + np.maximum(order - window, 0))
    found = first < np.arange(count)
    pos, prev = order[found], order[first[found]]
    back = np.argsort(pos)
    return pos[back], prev[back]


def ngram_matches(data: DataFrame, n: int = 6, window: int = 65535, key: str = "doc_id") -> DataFrame:
    """key, pos, prev: for each position, the oldest earlier one within the window that begins with the same n bytes.

    One pass over each byte string of column `data`, STRETCH bytes at a time with the window before them, so memory
    does not follow its length. n is 8 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1), strict=True):
                whole = np.frombuffer(x.as_buffer(), np.uint8)
                for a in range(0, len(whole), STRETCH):
                    lo = max(0, a - window)
                    pos, prev = _oldest(whole[lo : a + STRETCH + n - 1], n, window)
                    own = pos + lo >= a
                    pos, prev = pos[own] + lo, prev[own] + lo
                    if len(pos):
                        yield pa.record_batch([pa.repeat(i, len(pos)), pa.array(pos), pa.array(prev)], [key, "pos", "prev"])

    kind = dict(data.dtypes)[key]
    return data.select(key, "data").mapInArrow(run, f"{key} {kind}, pos long, prev long")


def tested_neighbours(points: DataFrame, centroids: DataFrame, features: list[str], key: str = "img_id", point: str = "pos") -> DataFrame:
    """key, point, cid, tested: the centroids that could be nearer than a point's own.

    A centroid at twice the point's distance or more from the own one cannot be nearer, so only those below count."""
    mine = centroids.select(key, "cid", *[F.col(f).alias(f"_{f}") for f in features])
    far = points.join(mine, [key, "cid"]).select(key, point, "cid", square_sum([F.col(f) for f in features], [F.col(f"_{f}") for f in features]).alias("own"))
    pairs = centroid_pairs(centroids, features, key).select(key, F.col("src").alias("cid"), "d2")
    near = F.count_if(F.col("d2") < 4 * F.col("own"))
    return far.join(pairs, [key, "cid"], "left").groupBy(key, point, "cid").agg(near.alias("tested"))
