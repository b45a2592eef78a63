"""Nearest centroids by neighbour lists, and k-means as rounds of plans over all images.

A point begins at its own centroid, at a distance d. No other centroid is nearer if the closest one to its own is 2 d away or
more (d is within the certainty radius). Otherwise the own centroid's neighbours are compared in the order of their
distance, up to the first that is more than 2 d away. Lists hold only as many neighbours as twice the furthest place that a
point has looked at in the round before (the high-water mark), at least the root of k; a point that comes to the
end of a shorter list has it doubled. So the result is that of comparing all centroids, whatever the lists' lengths.

In rounds, an image is rows of BLOCK points, so one of any size is many tasks' work; a round is one pass over the blocks,
a sum by image and one written table. What reaches the driver is whether any image goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rasterloom.sources.shared import discard, written

#: Points of a row.
BLOCK = 1 << 13
#: Centroids of all images of a round are broadcast up to so many bytes; beyond that they are joined by a shuffle.
BROADCAST = 16 << 20
_FAR = np.iinfo(np.int64).max
COUNTERS = ["moved", "stayed", "by_radius", "by_cutoff", "tested", "most_tested"]


def least_length(k: int) -> int:
    return min(k - 1, int(k**0.5))


def next_lengths(marks: np.ndarray, k: int) -> np.ndarray:
    """Lengths of lists after a round with these high-water marks."""
    return np.clip(2 * marks, least_length(k), k - 1)


class Neighbours:
    """For each centroid its nearest other ones, by distance and then number, as far as its list goes."""

    def __init__(self, c: np.ndarray, lengths: np.ndarray | None = None):
        self.c, k = c, len(c)
        self.lengths = np.full(k, k - 1) if lengths is None else np.minimum(lengths, k - 1)
        self._list()

    def _list(self) -> None:
        c, k = self.c, len(self.c)
        width = int(self.lengths.max(initial=0))
        self.ids, self.d2 = np.zeros((k, width), np.int64), np.zeros((k, width), np.int64)
        step = max(1, (1 << 21) // max(1, c.size))
        for i in range(0, k if width else 0, step):
            key = ((c[i : i + step, None, :] - c[None]) ** 2).sum(2) * k + np.arange(k)
            key[np.arange(len(key)), np.arange(i, i + len(key))] = _FAR
            key = np.sort(np.partition(key, width - 1, axis=1)[:, :width], axis=1)
            self.ids[i : i + step], self.d2[i : i + step] = key % k, key // k

    def grow(self, src: np.ndarray) -> None:
        self.lengths[src] = np.minimum(2 * np.maximum(self.lengths[src], 1), len(self.c) - 1)
        if self.lengths.max() > self.ids.shape[1]:
            self._list()

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """(cluster, squared distance, centroids compared, whether the certainty radius was enough) of points x, each with a
        centroid, the number of those that a neighbour cut off, and the high-water mark of each centroid. Equal
        distances go to the own centroid, then to the lowest number."""
        k, n = len(self.c), len(x)
        start = ((x - self.c[own]) ** 2).sum(1)
        best, d2, tested, looked = own.copy(), start.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        sure = 4 * start <= self.d2[own, 0] if self.ids.shape[1] else np.ones(n, bool)
        rows, p, cut = np.flatnonzero(~sure), 0, 0
        while len(rows) and p < k - 1:
            short = np.unique(own[rows[self.lengths[own[rows]] <= p]])
            if len(short):
                self.grow(short)
                continue
            looked[rows] = p + 1
            near = self.d2[own[rows], p] <= 4 * start[rows]
            cut += int((~near).sum())
            rows = rows[near]
            other = self.ids[own[rows], p]
            d = ((x[rows] - self.c[other]) ** 2).sum(1)
            tested[rows] += 1
            nearer = (d < d2[rows]) | ((d == d2[rows]) & (best[rows] != own[rows]) & (other < best[rows]))
            best[rows[nearer]], d2[rows[nearer]] = other[nearer], d[nearer]
            p += 1
        marks = np.zeros(k, np.int64)
        np.maximum.at(marks, own, looked)
        return best, d2, tested, sure, cut, marks


# a round over points as rows


def assign_pruned(points: DataFrame, centroids: DataFrame, features: list[str], key: str = "img_id", point: str = "pos", own: str = "cid", lengths: int | None = None) -> DataFrame:
    """key, point, cid, d2, tested, by_radius: of points that have a centroid (`own`), the nearest one, the number of others
    compared, and whether the certainty radius ended the search. lengths: of all lists at first; the whole by default.

    Points are shuffled once, in portions of some BLOCK points of an image, each with a copy of its centroids."""
    import pandas as pd

    kinds = dict(points.dtypes)
    schema = f"{key} {kinds[key]}, {point} {kinds[point]}, cid int, d2 long, tested long, by_radius boolean"
    per = centroids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cid", *features))).alias("_c"))
    parts = F.ceil(F.count("*").over(Window.partitionBy(key)) / F.lit(BLOCK))
    cut = points.select(key, point, own, *features, F.pmod(F.xxhash64(point), parts).alias("_part"))
    sizes = points.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_n"))
    sent = per.join(sizes, F.col(key) == F.col("_key")).select(F.col("_key").alias(key), "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part"))

    def find(pts: pd.DataFrame, cts: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(cts):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        rows = cts._c.iloc[0]
        ids = np.array([r["cid"] for r in rows])
        c = np.array([[r[f] for f in features] for r in rows], np.int64)
        lists = Neighbours(c, None if lengths is None else np.full(len(c), max(least_length(len(c)), lengths)))
        best, d2, tested, sure, _, _ = lists.nearest(pts[features].to_numpy(np.int64), np.searchsorted(ids, pts[own].to_numpy()))
        return pd.DataFrame({key: pts[key].to_numpy(), point: pts[point].to_numpy(), "cid": ids[best], "d2": d2, "tested": tested, "by_radius": sure})

    return cut.groupBy(key, "_part").cogroup(sent.groupBy(key, "_part")).applyInPandas(find, schema)


# rounds over blocks


def blocks(points: DataFrame, k: int, features: list[str], key: str, point: str) -> DataFrame:
    """key, block, points (array), x (their features one after another), cnt, cid: an image's points in their order, BLOCK a
    row, with the first assignment. An image of fewer points than k raises."""
    w = Window.partitionBy(key)
    placed = points.select(key, point, "cnt", *features, F.count("*").over(w).alias("_n"), (F.row_number().over(w.orderBy(point)) - 1).alias("_at"))
    first = F.when(F.col("_n") >= k, F.least(F.expr(f"(_n - 1 - _at) div greatest(_n div {k}, 1)"), F.lit(k - 1)).cast("int")).otherwise(F.raise_error(F.lit(f"fewer points than {k} clusters")).cast("int"))
    one = F.struct("_at", F.col(point).alias("p"), F.col("cnt").cast("long").alias("cnt"), first.alias("cid"), F.array(*[F.col(f).cast("int") for f in features]).alias("x"))
    rows = placed.groupBy(key, F.expr(f"_at div {BLOCK}").cast("long").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    return rows.select(key, "block", F.col("r.p").alias("points"), F.flatten("r.x").alias("x"), F.col("r.cnt").alias("cnt"), F.col("r.cid").alias("cid"))


def _first_model(held: DataFrame, k: int, width: int, key: str) -> DataFrame:
    """key, c (centroids one after another), lens, met, rounds: the first point of each chunk as its centroid."""
    # of a block only the first point of each chunk leaves it: its points are never rows that carry the block's features along
    starts = F.expr(f"filter(transform(sequence(0, {k} - 1), c -> struct(c AS cid, array_position(cid, c) AS i)), s -> s.i > 0)")
    cut = F.transform(starts, lambda s: F.struct(s["cid"].alias("cid"), F.slice("x", ((s["i"] - 1) * width + 1).cast("int"), F.lit(width)).alias("c")))
    each = held.select(key, "block", F.inline(cut))
    first = each.groupBy(key, "cid").agg(F.min_by("c", "block").alias("c"))
    whole = first.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cid", "c"))), lambda s: s["c"])).cast("array<long>").alias("c"))
    return whole.select(key, "c", F.array_repeat(F.lit(k - 1).cast("long"), k).alias("lens"), F.array().cast("array<string>").alias("met"))


def _join(held: DataFrame, model: DataFrame, n_models: int, k: int, width: int, key: str) -> DataFrame:
    small = n_models * (k * (width + 1) * 8 + 64) <= BROADCAST
    return held.join(F.broadcast(model) if small else model, key)


def _numpy(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False)


def _assign(joined: DataFrame, k: int, width: int, key: str, point_kind: str) -> DataFrame:
    """A row for each block with its new assignment, distances, sums by cluster, marks and counters."""
    kind = dict(joined.dtypes)[key]
    schema = f"{key} {kind}, block long, points array<{point_kind}>, x array<int>, cnt array<long>, cid array<int>, d2 array<long>, told array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: tuple = (None, None)
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                x = _numpy(b.column("x")).astype(np.int64).reshape(-1, width)
                own, cnt = _numpy(b.column("cid")).astype(np.int64), _numpy(b.column("cnt"))
                name = b.column(key)[0].as_py()
                if told[0] != name:
                    told = name, (_numpy(b.column("c")).reshape(k, width), _numpy(b.column("lens")))
                lists = Neighbours(told[1][0], told[1][1].copy())
                best, d2, tested, sure, cut, marks = lists.nearest(x, own)
                moved = int((best != own).sum())
                counters = np.array([moved, len(x) - moved, sure.sum(), cut, tested.sum(), tested.max(initial=0)])
                sums = np.zeros((k, width + 1), np.int64)
                np.add.at(sums, best, np.concatenate([x * cnt[:, None], cnt[:, None]], 1))
                lists_of = lambda v, t: pa.array([v.ravel()], pa.list_(t))
                yield pa.record_batch(
                    [b.column(key), b.column("block"), b.column("points"), b.column("x"), b.column("cnt"), lists_of(best.astype(np.int32), pa.int32()), lists_of(d2, pa.int64()), lists_of(np.concatenate([sums.ravel(), marks, counters]), pa.int64())],
                    [key, "block", "points", "x", "cnt", "cid", "d2", "told"],
                )

    return joined.select(key, "block", "points", "x", "cnt", "cid", "c", "lens").mapInArrow(run, schema)


def _totals(now: DataFrame, k: int, width: int, key: str) -> DataFrame:
    """key, sums, marks, counters and a signature of the assignment, by image, from one aggregation of the blocks' arrays."""
    n_sums = k * (width + 1)
    end = n_sums + k + len(COUNTERS)
    each = now.select(key, F.posexplode(F.concat("told", F.array(F.xxhash64("block", "cid")))).alias("i", "v"))
    # the last counter and the marks are largest values, what follows them all is a hash
    v = F.when(F.col("i") == end, F.expr("bit_xor(v)")).when((F.col("i") >= n_sums) & (F.col("i") < n_sums + k) | (F.col("i") == end - 1), F.max("v")).otherwise(F.try_sum("v"))
    cells = each.groupBy(key, "i").agg(v.alias("v")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("a"))
    return cells.select(key, F.slice("a", 1, n_sums).alias("sums"), F.slice("a", n_sums + 1, k).alias("marks"), F.slice("a", n_sums + k + 1, len(COUNTERS)).alias("counters"), F.element_at("a", end + 1).alias("state"))


def _furthest(now: DataFrame, needs: DataFrame, width: int, key: str) -> DataFrame:
    """key and spare: of images with empty clusters, as many of the points furthest from their centroid, first ones of equals.

    A block's own furthest ones are taken first, so no more than clusters of them leave a block."""
    ranked = F.slice(F.array_sort(F.transform("d2", lambda d, i: F.struct((-d).alias("d"), i.alias("i")))), F.lit(1), F.col("empty"))
    cut = F.transform(ranked, lambda s: F.struct((-s["d"]).alias("d"), s["i"].alias("i"), F.slice("x", s["i"] * width + 1, F.lit(width)).alias("v")))
    inner = now.join(needs, key).select(key, "block", "empty", F.inline(cut))
    outer = inner.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("d"), "block", "i"))).filter("r <= empty")
    return outer.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("spare"))


def _update(model: DataFrame, totals: DataFrame, spare: DataFrame | None, k: int, width: int, key: str, turn: int) -> DataFrame:
    """The next model, with `going`: whether the image has points that move and a state not met before. Native."""
    both = model.join(totals, key)
    both = both.join(spare, key, "left") if spare is not None else both.withColumn("spare", F.lit(None).cast("array<array<int>>"))
    n = f"element_at(sums, c * {width + 1} + {width + 1})"
    mean = f"transform(sequence(0, {width} - 1), f -> element_at(sums, c * {width + 1} + f + 1) div {n})"
    empties = f"filter(sequence(0, {k} - 1), c -> {n} = 0)"
    taken = "transform(element_at(spare, cast(array_position(empties, c) AS int)), v -> cast(v AS bigint))"
    fresh = F.expr(f"flatten(transform(sequence(0, {k} - 1), c -> CASE WHEN {n} = 0 THEN {taken} ELSE {mean} END))")
    low = least_length(k)
    lens = F.expr(f"transform(marks, m -> least(greatest(2 * m, {low}L), {k - 1}L))")
    grew = F.expr("size(filter(zip_with(marks, lens, (m, l) -> m > l), g -> g))").cast("long")
    out = both.withColumn("empties", F.expr(empties)).withColumn("next", fresh).withColumn("grew", grew)
    signature = F.concat_ws(":", F.col("state").cast("string"), F.xxhash64("next").cast("string"))
    out = out.withColumn("signature", signature).withColumn("moved", F.element_at("counters", 1))
    out = out.withColumn("going", (F.col("moved") > 0) & ~F.array_contains("met", F.col("signature")))
    return out.select(key, F.col("next").alias("c"), lens.alias("lens"), F.array_append("met", F.col("signature")).alias("met"), "counters", "grew", F.lit(turn).alias("round"), "going", (F.col("moved") == 0).alias("converged"))


def kmeans_rounds(points: DataFrame, k: int, features: list[str], key: str = "img_id", point: str = "pos", max_iter: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with cid and d2, centroids with `converged` and `round`, the counters of every round and image).

    points hold key, point, features and a weight `cnt`. The steps and results are those of kmeans.lloyd(): chunks from the
    tail, truncated weighted means, empty clusters refilled from the furthest points, an end when no point moves or a
    state comes again (or after max_iter rounds). An image that has ended takes no part in later rounds."""
    width = len(features)
    kinds = dict(points.dtypes)
    point_kind = kinds[point]
    held = written(blocks(points, k, features, key, point), "blocks")
    model = written(_first_model(held, k, width, key), "model")
    n_models, turn = model.count(), 0
    ended, models, logs = [], [], []
    while n_models and (max_iter is None or turn < max_iter):
        turn += 1
        now = written(_assign(_join(held, model, n_models, k, width, key), k, width, key, point_kind), "blocks")
        totals = written(_totals(now, k, width, key), "totals")
        needs = totals.select(key, F.expr(f"size(filter(sequence(0, {k} - 1), c -> element_at(sums, c * {width + 1} + {width + 1}) = 0))").alias("empty")).filter("empty > 0")
        spare = None if needs.isEmpty() else _furthest(now, needs, width, key)
        seen = Observation()
        last = F.lit(False) if turn == max_iter else F.col("going")
        after = written(_update(model, totals, spare, k, width, key, turn).withColumn("going", last).observe(seen, F.count_if("going").alias("n")), "model")
        over = after.filter("NOT going")
        ended.append(written(now.select(key, "points", "cid", "d2", "cnt", "x").join(over.select(key), key, "left_semi"), "ended"))
        models.append(over.select(key, "c", "converged", "round"))
        logs.append(after.select(key, "round", *[F.element_at("counters", i + 1).alias(c) for i, c in enumerate(COUNTERS)], "grew"))
        discard(held, totals)
        held, model, n_models = now, after.filter("going").select(key, "c", "lens", "met"), seen.get["n"]
    discard(held)
    done = _union(ended) if ended else None
    if done is None:
        empty = points.limit(0)
        mine = empty.select(key, point, F.lit(0).alias("cid"), F.lit(0).cast("long").alias("d2"), "cnt", *features)
        return mine, empty.select(key, F.lit(0).alias("cid"), *features, F.lit(True).alias("converged"), F.lit(0).alias("round")), empty.select(key, F.lit(0).alias("round"), *[F.lit(0).cast("long").alias(c) for c in [*COUNTERS, "grew"]])
    each = F.transform(F.arrays_zip("points", "cid", "d2", "cnt"), lambda p, i: F.struct(p["points"].alias(point), p["cid"].alias("cid"), p["d2"].alias("d2"), p["cnt"].alias("cnt"), *[F.element_at("x", i * width + j + 1).alias(f) for j, f in enumerate(features)]))
    mine = done.select(key, F.inline(each))
    cents = _union(models).select(key, "converged", "round", "c", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cid"))
    cents = cents.select(key, "cid", *[F.element_at("c", F.col("cid") * width + j + 1).cast("int").alias(f) for j, f in enumerate(features)], "converged", "round")
    return mine, cents, _union(logs)


def _union(frames: list[DataFrame]) -> DataFrame:
    """Pairwise, so that the plan is not deep."""
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2], strict=False)] + frames[len(frames) // 2 * 2 :]
    return frames[0]
