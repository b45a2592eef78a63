"""Operators over ordered sequences: differences, prefix sums, run lengths. All are partitioned by the sequence's key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import RGB, signed, unsigned
from rasterloom.operators.fold import folded

CAP = 255


def positions(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def delta(rows: DataFrame, key: list[str], order: str, columns: tuple[str, ...] = RGB) -> DataFrame:
    """d<column>: the difference to the row before, to zero for the first."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.select(*key, order, *[(signed(F.col(c)) - F.coalesce(F.lag(c).over(w), F.lit(0))).cast("smallint").alias(f"d{c}") for c in columns])


def delta_counts(points: np.ndarray) -> list[np.ndarray]:
    """Columns of the distinct differences of a whole sequence, and how often each comes."""
    found, n = np.unique(np.diff(points, axis=0, prepend=0), axis=0, return_counts=True)
    return [*found.T, n]


def undelta(rows: DataFrame, key: list[str], order: str, columns: tuple[str, ...] = RGB) -> DataFrame:
    """The inverse: prefix sums, each of which must be a byte."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*key, order, *[unsigned(F.sum(f"d{c}").over(w)).alias(c) for c in columns])


def series_diff(rows: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Differences without one for the first row."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.select(*key, order, (F.col(column) - F.lag(column).over(w)).alias("diff")).filter("diff IS NOT NULL")


def runs(rows: DataFrame, key: list[str], order: str, values: tuple[str, ...] = RGB, cap: int | None = CAP) -> DataFrame:
    """Maximal runs of equal values, cut at cap: key, seq (from 0), cnt, values."""
    w = Window.partitionBy(*key).orderBy(order)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    first = F.row_number().over(w) == 1
    flagged = rows.select(*key, order, *values, F.when(first | ~same, 1).otherwise(0).alias("_new"))
    numbered = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if cap:
        inner = Window.partitionBy(*key, "_run").orderBy(order)
        numbered = numbered.withColumn("_part", F.floor((F.row_number().over(inner) - 1) / cap))
    else:
        numbered = numbered.withColumn("_part", F.lit(0))
    grouped = numbered.groupBy(*key, "_run", "_part").agg(F.count("*").cast("int").alias("cnt"), *[F.first(v).alias(v) for v in values])
    return grouped.withColumn("seq", (F.row_number().over(Window.partitionBy(*key).orderBy("_run", "_part")) - 1).cast("long")).select(*key, "seq", "cnt", *values)


def count_runs(points: np.ndarray, cap: int = CAP) -> int:
    """How many runs() there are in a whole sequence."""
    edges = np.flatnonzero((points[1:] != points[:-1]).any(1)) + 1
    size = np.diff([0, *edges.tolist(), len(points)])
    return int((-(-size // cap)).sum())


def expand_runs(rle: DataFrame, key: list[str], values: tuple[str, ...] = RGB) -> DataFrame:
    """Runs back to rows: key, pos, values. A count below 1 raises."""
    checked = F.when(F.col("cnt") > 0, F.col("cnt")).otherwise(F.raise_error(F.lit("a run without members")).cast("int"))
    w = Window.partitionBy(*key).orderBy("seq")
    started = rle.withColumn("_at", F.sum("cnt").over(w) - F.col("cnt"))
    return started.select(*key, F.explode(F.sequence(F.lit(1), checked)).alias("_k"), "_at", *values).select(*key, (F.col("_at") + F.col("_k") - 1).cast("long").alias("pos"), *values)


class MeanRuns:
    """A fold over points: a run goes on while the next point is within `allowance` of the run's mean and it has room."""

    def __init__(self, allowance: float, width: int = 3, cap: int = CAP):
        if not 0 <= allowance < float("inf"):
            raise ValueError(f"allowance must be finite and not negative, not {allowance}")
        self.limit, self.cap, self.total, self.n = allowance * allowance, cap, [0.0] * width, 0

    def close(self) -> tuple[int, list[int]]:
        """The run's length and mean, rounded half away from zero; a new run begins."""
        out = self.n, [int(math.floor(t / self.n + 0.5)) for t in self.total]
        self.total, self.n = [0.0] * len(self.total), 0
        return out

    def add(self, point: tuple) -> tuple[int, list[int]] | None:
        """The run that this point ends, if it ends one."""
        done, n = None, self.n
        if n:
            far = 0.0
            for t, p in zip(self.total, point, strict=True):
                d = t / n - p
                far += d * d
            if n >= self.cap or far > self.limit:
                done = self.close()
        self.total = [t + p for t, p in zip(self.total, point, strict=True)]
        self.n += 1
        return done

    def stretch(self, points: np.ndarray) -> list[tuple[int, list[int]]]:
        """The runs that add() would end within these points of three numbers, in one loop."""
        out, n, limit, cap = [], self.n, self.limit, self.cap
        a, b, c = self.total
        for x, y, z in points.tolist():
            if n:
                u, v, w = a / n - x, b / n - y, c / n - z
                if n >= cap or u * u + v * v + w * w > limit:
                    self.total, self.n = [a, b, c], n
                    out.append(self.close())
                    a = b = c = 0.0
                    n = 0
            a, b, c, n = a + x, b + y, c + z, n + 1
        self.total, self.n = [a, b, c], n
        return out

    def runs(self, points: Iterator[tuple]) -> list[tuple[int, list[int]]]:
        """All runs of a whole sequence."""
        return [r for p in points if (r := self.add(p))] + self.rest()

    def rest(self) -> list[tuple[int, list[int]]]:
        return [self.close()] if self.n else []


class EqualRuns:
    """The same for equal points, a stretch at a time in arrays."""

    def __init__(self, cap: int = CAP):
        self.cap, self.value, self.n = cap, None, 0

    def stretch(self, points: np.ndarray) -> list[tuple[int, list[int]]]:
        """The runs that end within these points, which follow those before."""
        edges = (np.flatnonzero((points[1:] != points[:-1]).any(1)) + 1).tolist()
        out, firsts = [], [0, *edges]
        for a, b, value in zip(firsts, [*edges, len(points)], points[firsts].tolist(), strict=True):
            if value != self.value:
                out += self.rest()
                self.value = value
            self.n += b - a
            while self.n > self.cap:
                out.append((self.cap, value))
                self.n -= self.cap
        return out

    def rest(self) -> list[tuple[int, list[int]]]:
        out, self.n = [(self.n, self.value)] if self.n else [], 0
        return out


class _Runs:
    """Approximate runs as rows: seq, cnt, values."""

    def __init__(self, allowance: float, width: int):
        self.state, self.seq, self.width = MeanRuns(allowance, width), 0, width

    def _rows(self, got: list) -> list:
        self.seq += len(got)
        return [np.arange(self.seq - len(got), self.seq), [n for n, _ in got], *([m[i] for _, m in got] for i in range(self.width))]

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> list:
        add = self.state.add
        return self._rows([r for p in zip(*(v.tolist() for v in values), strict=True) if (r := add(p))])

    def end(self) -> list:
        return self._rows(self.state.rest())


class _Means:
    """Of each point its run, its place in it and the run's mean so far."""

    def __init__(self, allowance: float, width: int):
        self.state, self.run = MeanRuns(allowance, width), 0

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> list:
        state, out = self.state, []
        for point in zip(*(v.tolist() for v in values), strict=True):
            self.run += state.add(point) is not None
            out.append((self.run, state.n, *(t / state.n for t in state.total)))
        return [order, *map(list, zip(*out, strict=True))]

    def end(self) -> None:
        return None


def mean_runs(rows: DataFrame, allowance: float, key: str = "img_id", order: str = "pos", values: tuple[str, ...] = RGB) -> DataFrame:
    """Approximate runs: key, seq, cnt, values. Each depends on all before it; what is carried along is the open run."""
    MeanRuns(allowance)  # checks the allowance on the driver
    return folded(rows, key, order, list(values), lambda: _Runs(allowance, len(values)), "seq long, cnt int, " + ", ".join(f"{v} int" for v in values))


def running_means(rows: DataFrame, allowance: float, key: str = "img_id", order: str = "pos", values: tuple[str, ...] = RGB) -> DataFrame:
    """key, order, run, n and m<value>: of each point its approximate run, its place in it and the run's mean so far."""
    MeanRuns(allowance)
    kind = dict(rows.dtypes)[order]
    return folded(rows, key, order, list(values), lambda: _Means(allowance, len(values)), f"{order} {kind}, run long, n int, " + ", ".join(f"m{v} double" for v in values))
