"""Neighbour lists and rounds of k-means against brute force and against all rounds in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kmeans, pruned


def brute(x, c, own):
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    best, rows = d.argmin(1), np.arange(len(x))
    stays = d[rows, own] == d[rows, best]
    return np.where(stays, own, best), d[rows, best]


@pytest.mark.parametrize("width,k", [(3, 1), (3, 2), (3, 40), (5, 40), (5, 300)])
@pytest.mark.parametrize("lengths", [None, 1, 5])
def test_lists_give_the_nearest(width, k, lengths):
    r = np.random.default_rng(k + width)
    c = r.integers(0, 60, (k, width))
    c[k // 2] = c[0]  # two centroids in one place
    x = np.concatenate([r.integers(0, 60, (2000, width)), c])
    for own in (r.integers(0, k, len(x)), brute(x, c, np.zeros(len(x), np.int64))[0]):
        lists = pruned.Neighbours(c, None if lengths is None else np.full(k, lengths))
        best, d2, tested, sure, cut, marks = lists.nearest(x, own)
        want, far = brute(x, c, own)
        assert (best == want).all() and (d2 == far).all()
        assert (tested[sure] == 0).all() and cut <= (~sure).sum()
        start = ((x - c[own]) ** 2).sum(1)
        pairs = ((c[:, None] - c[None]) ** 2).sum(2)
        within = (pairs[own] <= 4 * start[:, None]).sum(1) - 1
        assert (tested == np.where(sure, 0, within)).all()
        assert (marks[own] >= tested).all() and (lists.lengths >= np.minimum(marks, k - 1)).all()


def test_lists_follow_the_high_water_mark():
    assert pruned.next_lengths(np.array([0, 3, 30, 90]), 100).tolist() == [10, 10, 60, 99]
    r = np.random.default_rng(1)
    c = r.integers(0, 200, (100, 3))
    x = np.repeat(c, 5, axis=0) + r.integers(-3, 4, (500, 3))
    own = brute(x, c, np.zeros(500, np.int64))[0]
    marks = pruned.Neighbours(c).nearest(x, own)[-1]
    short = pruned.Neighbours(c, pruned.next_lengths(marks, 100))
    assert short.ids.shape[1] < 60 and (short.nearest(x, own)[0] == own).all()
    before = short.lengths.copy()
    far = r.permutation(own)  # the next points are far from theirs, and lists grow
    assert (short.nearest(x, far)[0] == brute(x, c, far)[0]).all() and (short.lengths > before).any()


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(9)
    rows = []
    for img, n in ((1, 700), (2, 260), (3, 12), (4, 500)):
        x = r.integers(0, 256, (n, 3)) if img != 4 else np.repeat(r.integers(0, 256, (9, 3)), 56, axis=0)[:500]
        rows += [(img, 3 * i, int(r.integers(1, 9)), *map(int, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "img_id long, pos long, cnt int, r int, g int, b int").repartition(3)


@pytest.mark.parametrize("block", [64, 1 << 13])
def test_rounds_are_those_of_one_task(spark, points, monkeypatch, block):
    """Few points a block, empty clusters (image 4 has nine colours for twelve clusters), weights, an end by image."""
    monkeypatch.setattr(pruned, "BLOCK", block)
    mine, cents, log = pruned.kmeans_rounds(points, 12, ["r", "g", "b"])
    mine, cents, log = mine.toPandas(), cents.toPandas(), log.toPandas()
    for img, pdf in points.toPandas().groupby("img_id"):
        pdf = pdf.sort_values("pos")
        own, d2, c, ok = kmeans.lloyd(pdf[["r", "g", "b"]].to_numpy(np.int64), pdf.cnt.to_numpy(float), 12)
        got = mine[mine.img_id == img].sort_values("pos")
        assert got.pos.tolist() == pdf.pos.tolist() and got.cid.tolist() == own.tolist() and got.d2.tolist() == d2.tolist()
        assert got[["cnt", "r", "g", "b"]].to_numpy().tolist() == pdf[["cnt", "r", "g", "b"]].to_numpy().tolist()
        end = cents[cents.img_id == img].sort_values("cid")
        assert end[["r", "g", "b"]].to_numpy().tolist() == c.tolist() and end.converged.eq(ok).all()
        own_log = log[log.img_id == img].sort_values("round")
        assert own_log["round"].tolist() == list(range(1, end["round"].iloc[0] + 1))
        assert (own_log.moved + own_log.stayed).eq(len(pdf)).all() and (own_log.moved.iloc[-1] == 0) == ok


def test_large_images_by_rounds_and_small_ones_alone(points):
    one, one_c = kmeans.kmeans(points, 12, ["r", "g", "b"])
    two, two_c = kmeans.kmeans(points, 12, ["r", "g", "b"], alone=300)
    rows = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()))
    assert rows(one) == rows(two) and rows(one_c) == rows(two_c)


def test_rounds_of_nothing_and_of_too_little(points):
    for frame in pruned.kmeans_rounds(points.limit(0), 3, ["r", "g", "b"]):
        assert frame.collect() == []
    with pytest.raises(Exception, match="fewer points than 13"):
        pruned.kmeans_rounds(points, 13, ["r", "g", "b"])
    assert pruned.kmeans_rounds(points, 12, ["r", "g", "b"], max_iter=1)[1].filter(~F.col("converged")).count() > 0


def test_assignment_as_rows(points):
    """One round over rows, with short lists, and with an image that has no centroids."""
    assigned = kmeans.init_assignment(points, 12)
    cents = kmeans.init_centroids(assigned, ["r", "g", "b"])
    got = {(r.img_id, r.pos): r for r in pruned.assign_pruned(assigned, cents, ["r", "g", "b"], lengths=1).collect()}
    pdf, cpd = assigned.toPandas(), cents.toPandas()
    for img, own in pdf.groupby("img_id"):
        c = cpd[cpd.img_id == img].sort_values("cid")[["r", "g", "b"]].to_numpy()
        best, d2 = brute(own[["r", "g", "b"]].to_numpy(), c, own.cid.to_numpy())
        assert [(got[img, p].cid, got[img, p].d2) for p in own.pos] == list(zip(best.tolist(), d2.tolist(), strict=True))
    assert pruned.assign_pruned(assigned, cents.filter("img_id = 3"), ["r", "g", "b"]).count() == 12


def test_no_row_of_a_point_carries_its_block(spark):
    """Sums, first centroids and what is returned: features of a block leave it as one row, or cut to a point's own."""
    points = spark.range(3 * pruned.BLOCK).selectExpr("0L AS img_id", "id AS pos", "cast(id % 251 AS int) AS r", "cast(id % 7 AS int) AS g", "1 AS cnt")
    held = pruned.blocks(points, 4, ["r", "g"], "img_id", "pos")
    plan = pruned._first_model(held, 4, 2, "img_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    mine, centroids, _ = pruned.kmeans_rounds(points, 4, ["r", "g"], max_iter=1)
    assert "posexplode" not in mine._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(mine.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(3 * pruned.BLOCK)) and all((r.r, r.g) == (r.pos % 251, r.pos % 7) for r in rows)
    assert centroids.count() == 4
