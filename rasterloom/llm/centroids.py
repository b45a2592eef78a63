"""Centroid clustering of integer vectors: exact k-means rounds with an annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid it had last bounds its distance to the nearest from
above, so by the triangle inequality only centroids whose norms lie within that bound of its own norm can be nearer or as
near; two binary searches find them. They alone are compared, as integers, those on the border too, and of equal distances
the smaller number is taken. Norms are rounded outward before they are searched.

Each round ends in a table in the shared folder, with the cluster of every vector as the next round's bound. Sums by
cluster are aggregated natively; only k times the number of components reach the driver, where the floors are taken of exact integers.

Cases: null vectors, vectors of another length and those with a null or a component that is not finite are left out; an
empty table gives no rows; with fewer vectors than k each is a centroid at first; a row without an id is a vector like
others, its id hashed as an empty one; rows repeated with one id are a vector each, in the order of their components;
an empty cluster stays where it is; components from 2 ** 27 on would overflow the distance and raise; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, keep

#: Scaled components below this have distances that fit a long (at most 512 components).
MOST = 1 << 27
_HELD = "id long, vec array<long>, cluster int, distance long, tested long"


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """id and vec, floor(scale * x) of each component, of the vectors that are whole."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("v", lambda x: F.abs(x) * scale < MOST)
    vec = F.when(small, F.transform("v", lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more after scaling")))
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(whole).select("id", vec.alias("vec"))


class Annulus:
    """Centroids by norm."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, centroids compared) of each row of x; own: a centroid of each, or -1."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        own = np.where(own < 0, self.order[at], own).astype(np.int64)  # at first, one of the nearest norm
        best, d2 = own.copy(), ((x - self.c[own]) ** 2).sum(1)
        bound = np.sqrt(d2.astype(np.float64))
        slack = 1e-9 * (1 + norm + bound)  # far above what the roots are rounded by
        first = np.searchsorted(self.norms, norm - bound - slack, "left")
        end = np.searchsorted(self.norms, norm + bound + slack, "right")
        for k in range(int(first.min(initial=len(self.norms))), int(end.max(initial=0))):
            j = self.order[k]
            rows = np.flatnonzero((first <= k) & (k < end) & (own != j))
            d = ((x[rows] - self.c[j]) ** 2).sum(1)
            nearer = (d < d2[rows]) | ((d == d2[rows]) & (j < best[rows]))
            best[rows[nearer]], d2[rows[nearer]] = j, d[nearer]
        return best, d2, np.maximum(end - first, 1)


def assign(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, vec, cluster, distance and tested (centroids compared) of all vectors; a null cluster is unknown yet."""
    model = held.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(model.value)
        dim = model.value.shape[1]
        step = max(1, (1 << 20) // dim)  # some 8 MB of differences
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cluster, d2, tested = search.nearest(x, batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(d2), pa.array(tested.astype(np.int64))], ["id", "vec", "cluster", "distance", "tested"])

    return held.select("id", "vec", "cluster").mapInArrow(run, _HELD)


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the componentwise floor of its vectors' mean; empty ones as they are."""
    each = held.select("cluster", F.posexplode("vec").alias("i", "x"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def cluster(rows: DataFrame, k: int, rounds: int, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(id, vec, cluster, distance, tested of each vector, the final centroids)."""
    held = keep(integer_vectors(rows, vec_id, vector, dim, scale).withColumn("cluster", F.lit(None).cast("int")))
    centroids = first_centroids(held, k)
    if not len(centroids):
        return held.select("id", "vec", "cluster", F.lit(None).cast("long").alias("distance"), F.lit(None).cast("long").alias("tested")), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        now = keep(assign(held, centroids))
        discard(held)
        held, centroids = now, moved(now, centroids)
    now = keep(assign(held, centroids))
    discard(held)
    return now, centroids


def op11(rows: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: the columns of SQL. cluster() has `tested` besides."""
    held, centroids = cluster(rows, k, rounds)
    spark = rows.sparkSession
    sums = {r["cluster"]: r["s"] for r in held.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(i, sums.get(i, 0), total, n) for i, n in enumerate(names)], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    both = held.join(F.broadcast(told), held["cluster"] == told["c"])
    return both.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same by comparing all pairs, as long tables of components."""
    whole = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {whole})",
        "x AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN x USING (vec_id))",
    ]
    for n in range(rounds + 1):
        parts += [
            f"d{n} AS (SELECT vec_id, c, sum((x.x - k.x) * (x.x - k.x))::BIGINT AS d FROM x JOIN c{n} k USING (i) GROUP BY vec_id, c)",
            f"a{n} AS MATERIALIZED (SELECT vec_id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)",
        ]
        if n < rounds:
            # // cuts towards zero; sums are moved by a multiple of their count to be positive
            parts += [
                f"m{n} AS (SELECT c, i, (sum(x)::BIGINT + 1000000 * count(*)) // count(*) - 1000000 AS x FROM a{n} JOIN x USING (vec_id) GROUP BY c, i)",
                f"c{n + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN m{n} m USING (c, i))",
            ]
    return (
        "WITH " + ",\n".join(parts) + f",\nh AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)\n"
        f"SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256\nFROM a{rounds} JOIN h USING (c)"
    )


SQL = _sql()
