"""K-means over weighted integer points: its steps as plans over all images, and the whole of it an image at a time."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.joins import FEW, nearest, nearest_numpy
from rasterloom.operators.pruned import BLOCK, Neighbours, kmeans_rounds, next_lengths
from rasterloom.sources.shared import written

#: Points of an image that are one task's work; the rounds of a larger image are plans.
ALONE = 1 << 18

COLOUR, PLACE = ["r", "g", "b"], ["x", "y", "r", "g", "b"]


def weighted_mean(column: str, weight: str = "cnt"):
    """Truncated."""
    return F.expr(f"sum({column} * cast({weight} as bigint)) div sum(cast({weight} as bigint))").cast("int")


def init_assignment(points: DataFrame, k: int, key: str = "img_id", point: str = "pos") -> DataFrame:
    """points with cid: k - 1 chunks of n div k points are cut from the tail, and the head is the last cluster."""
    w = Window.partitionBy(key)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(point)) - 1
    placed = points.withColumn("_n", n).withColumn("_at", at)
    ok = F.when(F.col("_n") >= k, F.least(F.expr(f"(_n - 1 - _at) div greatest(_n div {k}, 1)"), F.lit(k - 1)).cast("int")).otherwise(F.raise_error(F.lit(f"fewer points than {k} clusters")).cast("int"))
    return placed.withColumn("cid", ok).drop("_n", "_at")


def init_centroids(assigned: DataFrame, features: list[str], key: str = "img_id", point: str = "pos") -> DataFrame:
    """The first point of each chunk."""
    return assigned.groupBy(key, "cid").agg(F.min_by(F.struct(*features), point).alias("m")).select(key, "cid", "m.*")


def update_centroids(assigned: DataFrame, features: list[str], key: str = "img_id") -> DataFrame:
    return assigned.groupBy(key, "cid").agg(*[weighted_mean(f).alias(f) for f in features])


def assign(points: DataFrame, centroids: DataFrame, features: list[str], k: int, key: str = "img_id", point: str = "pos") -> DataFrame:
    """points with their new cid and d2; a point stays unless another centroid is strictly nearer."""
    find = nearest if k <= 64 else nearest_numpy
    found = find(points, centroids, features, key, point, "cid")
    return points.drop("cid", "d2").join(found, [key, point])


def lloyd(x: np.ndarray, weight: np.ndarray, k: int, max_iter: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(cluster of each point, squared distances, centroids, converged) of one image's points, in their order.

    The same steps as the functions above: chunks from the tail, the first point of each as its centroid, a point moves
    only to a strictly nearer centroid and to the lowest of equals, truncated weighted means. An empty cluster takes
    the point that is furthest from its own centroid, the first of equals; several take the next ones.
    Distances are compared along neighbour lists (Neighbours). It ends when no point moves. Truncated means may come round in a circle: a state met before ends it unconverged."""
    n = len(x)
    if n < k:
        raise ValueError(f"fewer points than {k} clusters")
    own = np.minimum((n - 1 - np.arange(n)) // (n // k), k - 1)
    c = x[[np.flatnonzero(own == i)[0] for i in range(k)]]
    d2, rows, lengths = np.zeros(n, np.int64), np.arange(n), None
    met: set[bytes] = set()
    for _ in itertools.count() if max_iter is None else range(max_iter):
        new, marks, lists = np.empty(n, np.int64), np.zeros(k, np.int64), Neighbours(c, lengths)
        for i in range(0, n, BLOCK):
            part = slice(i, i + BLOCK)
            new[part], d2[part], _, _, _, looked = lists.nearest(x[part], own[part])
            marks = np.maximum(marks, looked)
        lengths = next_lengths(marks, k)
        moved = bool((new != own).any())
        own = new
        total = np.bincount(own, weight, k)
        c = np.stack([np.bincount(own, weight * x[:, f], k) for f in range(x.shape[1])], 1).astype(np.int64) // np.maximum(total, 1).astype(np.int64)[:, None]
        empty = np.flatnonzero(total == 0)
        if len(empty):
            c[empty] = x[np.lexsort([rows, -d2])[: len(empty)]]
        if not moved:
            return own, d2, c, True
        state = hashlib.sha256(own.tobytes() + c.tobytes()).digest()
        if state in met:
            break
        met.add(state)
    return own, d2, c, False


def kmeans(points: DataFrame, k: int, features: list[str], key: str = "img_id", point: str = "pos", max_iter: int | None = None, alone: int = ALONE) -> tuple[DataFrame, DataFrame]:
    """points with cid and d2, and centroids with `converged`. points hold key, point, features and a weight `cnt`.

    An image of up to `alone` points (distinct colours, or pixels) is one task for all its rounds, after one shuffle; of
    larger ones each round is a plan over blocks of points (kmeans_rounds). Results are the same either way. What is returned
    comes from written tables."""
    if not 1 <= k <= FEW:
        raise ValueError(f"k must be from 1 to {FEW}")
    columns = [key, point, "cid", "d2", "cnt", *features]
    sizes = written(points.groupBy(key).agg((F.count("*") > alone).alias("large")), "sizes")
    large = sizes.filter("large").select(key)
    if large.isEmpty():
        return _alone(points, k, features, key, point, max_iter)
    mine, cents, _ = kmeans_rounds(points.join(large, key, "left_semi"), k, features, key, point, max_iter)
    small, small_cents = _alone(points.join(large, key, "left_anti"), k, features, key, point, max_iter)
    return small.select(columns).unionByName(mine.select(columns)), small_cents.unionByName(cents.drop("round"))


def _alone(points: DataFrame, k: int, features: list[str], key: str, point: str, max_iter: int | None) -> tuple[DataFrame, DataFrame]:
    """One shuffle for all rounds, an image a task."""
    kinds = dict(points.dtypes)
    schema = f"{key} {kinds[key]}, {point} {kinds[point]}, cid int, d2 long, cnt long, converged boolean, " + ", ".join(f"{f} int" for f in features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        x = pdf[features].to_numpy(np.int64)
        own, d2, c, ok = lloyd(x, pdf.cnt.to_numpy(float), k, max_iter)
        mine = pd.DataFrame({key: pdf[key].to_numpy(), point: pdf[point].to_numpy(), "cid": own, "d2": d2, "cnt": pdf.cnt.to_numpy(), "converged": ok, **{f: x[:, i] for i, f in enumerate(features)}})
        cents = pd.DataFrame({key: pdf[key].iloc[0], point: None, "cid": range(k), "d2": None, "cnt": None, "converged": ok, **{f: c[:, i] for i, f in enumerate(features)}})
        return pd.concat([mine.astype(object), cents.astype(object)])

    both = written(points.select(key, point, "cnt", *features).groupBy(key).applyInPandas(run, schema), "clusters")
    return both.filter(F.col(point).isNotNull()).drop("converged"), both.filter(F.col(point).isNull()).select(key, "cid", *features, "converged")


def cluster_counts(assigned: DataFrame, k: int, key: str = "img_id") -> DataFrame:
    """Points, clusters in use, and whether they are enough: within one percent of what was asked, or of the points."""
    per = assigned.groupBy(key, "cid").agg(F.count("*").alias("n"))
    out = per.groupBy(key).agg(F.sum("n").alias("points"), F.count_if(F.col("n") > 0).alias("active"))
    return out.withColumn("enough", F.col("active") >= F.least(F.col("points"), F.lit(int(0.99 * k))))
