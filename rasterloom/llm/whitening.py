"""Whitening of embeddings by block Lanczos on their covariance, which is never formed.

A pass over the vectors multiplies a block of directions by the covariance: each task sums x (x'Q) of its centred rows, and
the sums are added up in two steps, a bounded number of them on the driver. The basis is orthogonalised twice against all
of itself; where a block has lost directions (breakdown), random ones that are orthogonal to the basis take their place.
Ritz pairs are taken from the basis and its products until the residual of every wanted one is below a tolerance, or the
basis spans the whole space, where they are exact. A basis that has grown to its bound is restarted from its best Ritz vectors
and the residuals of the wanted ones.

Entries are integers, so rows are centred without rounding: n * x - S is exact, and only its quotient by n is a
double. The trace comes from the same exact deviations.

Cases: null vectors and vectors with a null or an entry that is not finite are left out; of several lengths the most
frequent one (of equals the largest) is taken and the rest left out; an empty table gives no rows; a component without
variance is not reported, so vectors that are all alike give no rows; repeated rows and ids give their rows each; a
deviation beyond a long, or entries whose sums are, raise; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import discard, keep

#: Sums of tasks are added up in so many places before the driver adds those.
PLACES = 16
#: A residual of a wanted pair, as a share of the largest eigenvalue, that counts as converged.
TOLERANCE = 1e-13
#: Eigenvalues below this share of the largest count as none.
LEAST = 1e-13
SCALE, SHIFT = 64, 1_000_000


def integer_rows(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and x, floor(SCALE * entry) + SHIFT, of the vectors that are whole and of the usual length."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(whole).select("id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 20) // dim)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def summed(rows: DataFrame, dim: int, shape: tuple[int, ...], kind: str, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of add(x) over blocks x of rows, an array of a bounded shape."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, kind)
        for batch in _parts(batches, dim):
            total += add(_matrix(batch, dim))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % PLACES]), pa.array([total.tobytes()], pa.binary())], ["place", "total"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(1).to_pylist():
                part = np.frombuffer(data, kind)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["place", "total"])

    schema = "place long, total binary"
    got = rows.select("x").mapInArrow(task, schema).repartition(PLACES, "place").mapInArrow(join, schema).collect()
    return sum((np.frombuffer(r["total"], kind) for r in got), np.zeros(int(np.prod(shape)), kind)).reshape(shape)


class Centred:
    """What a task needs to centre its rows without rounding: n and the sums of all dimensions."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums

    def exact(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x - SHIFT) - (self.sums - self.n * SHIFT)

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> tuple[np.ndarray, int]:
    """The block's directions orthogonal to the basis and each other, and how many were lost and drawn anew. scale: of the
    directions' lengths, against which they count as lost. There are at most as many as the space has room for."""
    out, lost = [], 0
    room = len(basis) - basis.shape[1]
    for v in block.T[:room]:
        v, fresh = v.copy(), False
        while True:
            size = np.linalg.norm(v)
            for _ in range(2):  # twice is enough
                v -= basis @ (basis.T @ v)
                for q in out:
                    v -= q * (q @ v)
            left = np.linalg.norm(v)
            if left > 1e-12 * (size if fresh else max(size, scale)):
                # what is left after much was taken away has to be cleaned once more
                v /= left
                v -= basis @ (basis.T @ v)
                for q in out:
                    v -= q * (q @ v)
                out.append(v / np.linalg.norm(v))
                break
            v, fresh, lost = rng.standard_normal(len(v)), True, lost + 1
    return np.stack(out, 1) if out else np.zeros((len(basis), 0)), lost


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int | None = None, most: int | None = None, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues falling, unit vectors as columns, what happened) of a symmetric positive operator's largest pairs.

    most: columns of the basis before a restart."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    block = min(block or max(1, (wanted + 1) // 2), dim)
    most = min(dim, most or max(4 * wanted, wanted + 2 * block))
    basis, products = np.zeros((dim, 0)), np.zeros((dim, 0))
    told = {"passes": 0, "restarts": 0, "lost": 0}
    new, _ = orthonormal(rng.standard_normal((dim, block)), basis, rng, 0.0)
    while True:
        basis, products = np.hstack([basis, new]), np.hstack([products, multiply(new)])
        told["passes"] += 1
        small = basis.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        have = min(wanted, basis.shape[1])
        vectors = basis @ turn[:, :have]
        residuals = products @ turn[:, :have] - vectors * values[:have]
        top = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(np.linalg.norm(residuals, axis=0).max()) / top
        whole = basis.shape[1] == dim
        if whole or (have == wanted and worst <= tolerance):
            return values[:have], vectors / np.linalg.norm(vectors, axis=0), told | {"residual": worst}
        if basis.shape[1] + block > most and most < dim:
            told["restarts"] += 1
            keep_ = min(basis.shape[1], max(wanted, most - 2 * block))
            basis, products = basis @ turn[:, :keep_], products @ turn[:, :keep_]
            new, lost = orthonormal(residuals[:, np.argsort(-np.linalg.norm(residuals, axis=0))[:block]], basis, rng, top)
        else:
            new, lost = orthonormal(products[:, -new.shape[1] :], basis, rng, top)
        told["lost"] += lost


class Whitening:
    """The fit: n, sums, trace, eigenvalues and vectors, and what the solver did."""

    def __init__(self, rows: DataFrame, components: int = 32, block: int | None = None, most: int | None = None):
        """rows: id and x, written, of one length."""
        far = F.max(F.array_max(F.transform("x", lambda v: F.abs(v - SHIFT))))
        sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), far.alias("far")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        self.dim, self.n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
        self.rows, self.values, self.vectors, self.trace, self.told = rows.filter(F.size("x") == self.dim), np.zeros(0), np.zeros((self.dim, 0)), 0.0, {}
        if not self.dim:
            return
        dim, n = self.dim, self.n
        if 2 * n * sizes[0]["far"] >= 1 << 62:
            raise OverflowError(f"entries of up to {sizes[0]['far']} are too large for exact sums of {n} rows")
        # sums of x - SHIFT stay far from the limits of a long
        sums = summed(self.rows, dim, (dim,), "int64", lambda x: (x - SHIFT).sum(0)) + n * SHIFT
        self.centred = c = Centred(n, sums)
        self.trace = float(summed(self.rows, dim, (1,), "float64", lambda x: (c.values(x) ** 2).sum(keepdims=True).reshape(1))[0]) / n
        if self.trace == 0:
            return
        self.values, self.vectors, self.told = eigenpairs(self.multiply, dim, components, block, most)
        real = self.values > LEAST * self.values[0]
        self.values, self.vectors = self.values[real], self.vectors[:, real]

    def multiply(self, q: np.ndarray) -> np.ndarray:
        """The covariance times a block, by one pass."""
        c, shape = self.centred, q.shape
        sent = self.rows.sparkSession.sparkContext.broadcast(q)

        def add(x: np.ndarray) -> np.ndarray:
            v = c.values(x)
            return v.T @ (v @ sent.value)

        return summed(self.rows, self.dim, shape, "float64", add) / self.n

    def identity_error(self) -> float:
        """The largest entry, without its sign, of the covariance of the whitened rows less the identity."""
        c, to, k = self.centred, self.vectors / np.sqrt(self.values), len(self.values)

        def add(x: np.ndarray) -> np.ndarray:
            w = c.values(x) @ to
            return w.T @ w

        return float(np.abs(summed(self.rows, self.dim, (k, k), "float64", add) / self.n - np.eye(k)).max(initial=0))

    def transform(self) -> DataFrame:
        """id, deviation (exact) and whitened array<double> of each row."""
        if not len(self.values):
            return self.rows.sparkSession.createDataFrame([], "id long, deviation long, whitened array<double>")
        c, to, dim, k = self.centred, self.vectors / np.sqrt(self.values), self.dim, len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches, dim):
                e = c.exact(_matrix(batch, dim))
                if len(e) and np.abs(e).max() >= (1 << 31) / dim**0.5:
                    exact = [sum(int(v) ** 2 for v in r) for r in e.tolist()]  # pyarrow raises where a long is too small
                else:
                    exact = (e**2).sum(1)
                w = (e.astype(np.float64) / c.n) @ to
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(w) + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.record_batch([batch.column(0), pa.array(exact, pa.int64()), lists], ["id", "deviation", "whitened"])

        return self.rows.select("id", "x").mapInArrow(run, "id long, deviation long, whitened array<double>")


def op13(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    held = keep(integer_rows(rows, vec_id, vector))
    fit = Whitening(held, components)
    if not len(fit.values):
        discard(held)
        return rows.sparkSession.createDataFrame([], StructType.fromDDL("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"))
    share = F.array(*[F.lit(float(e)) for e in fit.values / fit.trace])
    each = fit.transform().select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(F.col("id").alias("vec_id"), (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(fit.identity_error()).alias("identity_error"))
