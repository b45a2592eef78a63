import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.scalar import hilbert_index, large_side, next_pow2, small_side
from rasterloom.operators.scan import rect_places

def rect_order(w: int, h: int) -> np.ndarray:
    """Positions along a generalised Hilbert curve of a w x h rectangle, as an (h, w) array.

    The rectangle is halved along its longer edge, or, if it is not so long, cut in three turned parts; a part of one
    row or column is a line. This is the generalised Hilbert curve of Jakub Cerveny's gilbert (2018), with a stack in
    place of recursion; its licence (BSD 2-Clause) is in NOTICE. Squares of a power of two follow the Hilbert curve's
    quadrants."""
    out = np.zeros((h, w), np.int64)
    at = 0
    stack = [(0, 0, w, 0, 0, h) if w >= h else (0, 0, 0, h, w, 0)]
    if w == h and w & (w - 1) == 0:  # the exact curve, with the corner order that squares have
        xy = _square(w)
        out[xy[:, 1], xy[:, 0]] = np.arange(w * h)
        return out
    while stack:
        x, y, ax, ay, bx, by = stack.pop()
        n, m = abs(ax + ay), abs(bx + by)
        dax, day, dbx, dby = np.sign(ax), np.sign(ay), np.sign(bx), np.sign(by)
        if n == 0 or m == 0:
            continue
        if m == 1 or n == 1:
            k, dx, dy = (n, dax, day) if m == 1 else (m, dbx, dby)
            steps = np.arange(k)
            out[y + dy * steps, x + dx * steps] = at + steps
            at += k
            continue
        ax2, ay2, bx2, by2 = ax // 2 if ax >= 0 else -(-ax // 2), ay // 2 if ay >= 0 else -(-ay // 2), bx // 2 if bx >= 0 else -(-bx // 2), by // 2 if by >= 0 else -(-by // 2)
        if 2 * n > 3 * m:
            if abs(ax2 + ay2) % 2 and n > 2:
                ax2, ay2 = ax2 + dax, ay2 + day
            stack += [(x + ax2, y + ay2, ax - ax2, ay - ay2, bx, by), (x, y, ax2, ay2, bx, by)]
        else:
            if abs(bx2 + by2) % 2 and m > 2:
                bx2, by2 = bx2 + dbx, by2 + dby
            stack += [
                (x + (ax - dax) + (bx2 - dbx), y + (ay - day) + (by2 - dby), -bx2, -by2, -(ax - ax2), -(ay - ay2)),
                (x + bx2, y + by2, ax, ay, bx - bx2, by - by2),
                (x, y, bx2, by2, ax2, ay2),
            ]
    return out


def _square(n: int) -> np.ndarray:
    """(x, y) along the Hilbert curve, built by doubling: four turned copies."""
    xy = np.zeros((1, 2), np.int64)
    side = 1
    while side < n:
        turned = xy[:, ::-1]
        last = np.stack([2 * side - 1 - xy[:, 1], side - 1 - xy[:, 0]], 1)
        xy = np.concatenate([turned, xy + [0, side], xy + [side, side], last])
        side *= 2
    return xy


#: Places of a 4 x 4 picture in the order of the curve.
ORDER4 = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 2), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1), (2, 0), (3, 0)]


def test_four_by_four(spark):
    cells = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    rows = cells.withColumn("d", hilbert_index(F.col("x"), F.col("y"), F.lit(4))).orderBy("d").collect()
    assert [(r.x, r.y) for r in rows] == ORDER4
    order = rect_order(4, 4)
    assert [order[y, x] for x, y in ORDER4] == list(range(16))


@pytest.mark.parametrize("w, h", [(1, 1), (1, 9), (9, 1), (2, 2), (3, 5), (7, 7), (8, 8), (13, 8), (32, 234), (100, 63)])
def test_rectangles_visit_every_cell(w, h):
    order = rect_order(w, h)
    assert sorted(order.ravel()) == list(range(w * h))
    at = np.argsort(order.ravel())
    steps = np.abs(np.diff(at % w)) + np.abs(np.diff(at // w))
    assert (steps > 1).sum() <= 1


def test_sides(spark):
    rows = spark.createDataFrame([(4, 4), (5, 9), (1, 7), (1, 1)], "w int, h int")
    got = rows.select(small_side(F.col("w"), F.col("h")), large_side(F.col("w"), F.col("h")), next_pow2(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(2, 4, 4), (4, 16, 8), (0, 8, 1), (0, 1, 1)]


def test_places_are_those_of_the_whole_curve():
    """Of all sizes to 40 x 40 each cell alone, and cells of pictures of many sizes at once."""
    sizes = [(w, h) for w in range(1, 41) for h in range(1, 41)]
    want = np.concatenate([rect_order(w, h).ravel() for w, h in sizes])
    pos = [np.arange(w * h) for w, h in sizes]
    each = lambda f: np.concatenate([np.broadcast_to(f(p, w, h), p.shape) for p, (w, h) in zip(pos, sizes, strict=True)])
    got = rect_places(each(lambda p, w, h: p % w), each(lambda p, w, h: p // w), each(lambda p, w, h: w), each(lambda p, w, h: h))
    assert (got == want).all()


def test_places_of_a_picture_that_would_not_fit():
    """A billion pixels: neighbours on the curve are neighbours in the picture."""
    w, h = 40_000, 30_000
    x, y = np.meshgrid(np.arange(20_000, 20_040), np.arange(7_000, 7_040))
    at = rect_places(x.ravel(), y.ravel(), w, h)
    order = np.argsort(at)
    near = np.diff(at[order]) == 1
    steps = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert near.sum() > 1200 and (steps[near] == 1).all() and at.max() < w * h
    assert rect_places(np.array([0]), np.array([0]), w, h).tolist() == [0]


def test_more_rows_come_in_more_tasks(spark, monkeypatch):
    """Rows of a task do not grow with the table, and what follows needs no exchange of its own."""
    from rasterloom.operators import sequence
    from rasterloom.operators.fold import folded
    from rasterloom.operators.scan import Along
    from rasterloom.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    px = spark.range(10_000).selectExpr("id div 16 AS img_id", "id % 16 AS pos", "CAST(id % 4 AS INT) AS x", "CAST(id % 16 div 4 AS INT) AS y", *[f"CAST(hash(id, {k}) & 1 AS INT) AS {c}" for k, c in enumerate("rgb")])
    hist = folded(tables.dealt(px, 10_000), "img_id", "pos", ["x", "y", *"rgb"], lambda: Along(sequence.delta_counts), "dr smallint, dg smallint, db smallint, cnt long")
    assert hist.rdd.getNumPartitions() == 20
    assert hist._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert tables.dealt(px, 2000).rdd.getNumPartitions() == px.rdd.getNumPartitions()
    from rasterloom.operators.scan import on_curve

    along = on_curve(px)
    want = sequence.delta(along, ["img_id"], "hidx").groupBy("img_id", "dr", "dg", "db").count()
    assert sorted(map(tuple, hist.collect())) == sorted(map(tuple, want.collect()))
    runs = sequence.runs(along, ["img_id"], "hidx", cap=3).groupBy("img_id").count()
    mine = folded(px, "img_id", "pos", ["x", "y", *"rgb"], lambda: Along(lambda p: [[sequence.count_runs(p, 3)]]), "n long")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, runs.collect()))
