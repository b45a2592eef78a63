import hashlib
import math

import numpy as np
import pytest

from rasterloom.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id long, cluster int, x string"


def rows_of(vectors, ids=None):
    return [(i, v, 0, 9, 1, "x") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]


def awkward(n=120, seed=3):
    r = np.random.default_rng(seed)
    good = (r.standard_normal((n, 64)) * 0.2).astype(np.float32)
    good[5] = good[6]  # ties
    good[7:20] = good[7]
    good[20] = 0
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.5] * 63, [math.nan] + [0.5] * 63, [math.inf] + [0.5] * 63, [-math.inf] + [0.5] * 63]
    return good.tolist() + bad


def plain_kmeans(rows, k, rounds):
    """The contract in plain integers."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(whole, key=lambda r: (hashlib.sha256(b"2:" + (b"" if r[0] is None else str(r[0]).encode())).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in whole]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(whole, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in whole]
    inertia = [sum(d for d, j in last if j == k) for k in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted((str(i), j, d, inertia[j], sum(inertia), name[j]) for (i, _), (d, j) in zip(whole, last, strict=True))


@pytest.mark.parametrize("ids", [None, "odd"])
def test_centroids_against_plain_integers(spark, ids):
    vectors = awkward()
    rows = rows_of(vectors, None if ids is None else [None if i % 50 == 3 else i // 2 for i in range(len(vectors))])
    got = centroids.op11(spark.createDataFrame(rows, SCHEMA).repartition(3), k=9, rounds=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain_kmeans(rows, 9, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = rows_of(awkward()[:3])
    got = centroids.op11(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.cluster, r.distance) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert centroids.op11(spark.createDataFrame(rows_of(awkward()[-8:]), SCHEMA)).collect() == []
    assert centroids.op11(spark.createDataFrame([], SCHEMA)).collect() == []


def test_annulus_leaves_out_only_what_cannot_be_nearest():
    """Of norms that differ few centroids are compared; ties on the border go to the smaller number."""
    r = np.random.default_rng(1)
    c = r.integers(-50, 50, (60, 8)) * r.integers(1, 400, (60, 1))
    c[30] = -c[10]
    x = np.concatenate([c[r.integers(0, 60, 400)] + r.integers(-9, 9, (400, 8)), np.zeros((1, 8), np.int64)])
    best, d2, tested = centroids.Annulus(c).nearest(x, r.integers(-1, 60, len(x)))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (d2 == full.min(1)).all()
    start = full.argmin(1)
    again, _, tested = centroids.Annulus(c).nearest(x, start)
    assert (again == start).all() and tested.mean() < 20
    line = np.array([[5, 0], [-5, 0], [0, 5]])
    assert centroids.Annulus(line).nearest(np.zeros((1, 2), np.int64), np.array([2]))[0].tolist() == [0]


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="or more after scaling"):
        centroids.op11(spark.createDataFrame(rows_of([[1e30] * 64]), SCHEMA)).collect()


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], np.int64)
    n, s = len(x), x.sum(0)
    e = n * x - s
    v = (e / n).T @ (e / n) / n
    values, to = np.linalg.eigh(v)
    values, to = values[::-1][:k], to[:, ::-1][:, :k]
    return (e**2).sum(1), (e / n) @ to / np.sqrt(values), values / np.trace(v)


def test_whitening_against_plain_eigenvectors(spark):
    r = np.random.default_rng(5)
    vectors = awkward(200)
    good = vectors[:200] * np.linspace(0.5, 4, 64)
    rows = rows_of([*good.tolist(), None, [None] * 64, [math.nan] * 64, [1.0] * 63])
    r.shuffle(rows)
    got = whitening.op13(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    assert len(got) == 200 * 32 and got.n.eq(200).all() and got.identity_error.max() < 1e-9
    deviation, whitened, explained = plain_whitening(np.array(good, np.float32).tolist(), 32)
    assert got.drop_duplicates("vec_id").set_index("vec_id").deviation.sort_index().tolist() == deviation.tolist()
    mine = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    mine = mine * np.sign((mine * whitened).sum(0))
    assert np.abs(mine - whitened).max() < 1e-8
    assert np.abs(got.drop_duplicates("component").set_index("component").explained.sort_index() / explained - 1).max() < 1e-12


def test_whitening_of_little(spark):
    """No vector, equal vectors, a line, repeated rows and ids."""
    frame = lambda vs: spark.createDataFrame([(1, v) for v in vs], "vec_id long, embedding array<float>")
    for vs in ([], [None], [[]], [[0.5, 0.5]] * 4):
        assert whitening.op13(frame(vs)).collect() == []
    got = whitening.op13(frame([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0], [3.0, 6.0]])).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    assert len(whitening.op13(frame([[1.0, 2.0], [2.0, 3.5]])).collect()) == 2


def test_large_entries_raise(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.op13(spark.createDataFrame([(1, [1e17]), (2, [0.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="(?i)overflow|too large|out of bounds|too big"):
        whitening.op13(spark.createDataFrame([(1, [1e16]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("block,most", [(1, None), (3, 14), (8, 30), (20, None)])
def test_lanczos_restarts_and_breaks_down(block, most):
    """Eigenpairs of a matrix with a cluster, repeated values and no full rank, with a small basis and with a wide block."""
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((90, 90)))[0]
    values = np.concatenate([[9, 9, 9, 5, 5], np.linspace(4, 1, 15), np.linspace(0.4, 0.01, 30), np.zeros(40)])
    a = (q * values) @ q.T
    got, vectors, told = whitening.eigenpairs(lambda b: a @ b, 90, 8, block, most)
    assert np.allclose(got, values[:8], atol=1e-10)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-10 and np.abs(a @ vectors - vectors * got).max() < 1e-9
    if most:
        assert told["restarts"] > 0


def test_lanczos_finds_lost_directions():
    """The identity has an invariant space in every block, so each step breaks down and goes on from random directions."""
    got, vectors, told = whitening.eigenpairs(lambda b: b * 2.0, 20, 12, 5)
    assert np.allclose(got, 2) and told["lost"] > 0 and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-10


def test_columns_are_those_of_sql(spark):
    got = centroids.op11(spark.createDataFrame(rows_of(awkward()[:3]), SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
