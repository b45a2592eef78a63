"""Runs as a table function for SQL, with the criterion that keeps a run going as an argument.

    register(spark)
    spark.sql("SELECT * FROM runs(TABLE(pixels) PARTITION BY img_id ORDER BY pos, "
              "key => 'img_id', columns => 'r,g,b', criterion => 'mean', allowance => 16.0)")

The rows of a partition are one sequence; without PARTITION BY the table is. A run begins with a row, goes on while its
criterion accepts the next one and it has fewer than `cap` rows, and is given as key, seq (from 0), cnt and the
criterion's value. A partition without rows gives none; null values are equal to each other, and 'mean' refuses them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, NumericType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rasterloom.operators.sequence import CAP, MeanRuns


class Equal:
    """Rows that are equal to the first one, which is the value."""

    numeric = False

    def __init__(self, width: int, allowance: float):
        if allowance:
            raise ValueError("equal runs have no allowance")

    def begin(self, point: tuple) -> None:
        self.first = point

    def accepts(self, point: tuple) -> bool:
        return point == self.first

    def value(self) -> tuple:
        return self.first


class Mean:
    """Rows within `allowance` of the mean of those before; the value is the mean, rounded half away from zero."""

    numeric = True

    def __init__(self, width: int, allowance: float):
        self.limit = MeanRuns(allowance).limit

    def begin(self, point: tuple) -> None:
        self.total, self.n = [float(p) for p in point], 1

    def accepts(self, point: tuple) -> bool:
        far = 0.0
        for t, p in zip(self.total, point, strict=True):
            d = t / self.n - p
            far += d * d
        if far > self.limit:
            return False
        self.total, self.n = [t + p for t, p in zip(self.total, point, strict=True)], self.n + 1
        return True

    def value(self) -> tuple:
        return tuple(math.floor(t / self.n + 0.5) for t in self.total)


class Near:
    """Rows of which every column is within `allowance` of the first row's, which is the value."""

    numeric = True

    def __init__(self, width: int, allowance: float):
        MeanRuns(allowance)  # checks the allowance
        self.allowance = allowance

    def begin(self, point: tuple) -> None:
        self.first = point

    def accepts(self, point: tuple) -> bool:
        return all(abs(a - b) <= self.allowance for a, b in zip(point, self.first, strict=True))

    def value(self) -> tuple:
        return self.first


CRITERIA = {"equal": Equal, "mean": Mean, "near": Near}


def names(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(",") if c.strip()]


class Runs:
    """The handler: a partition's open run is all that it holds."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, columns: AnalyzeArgument, criterion: AnalyzeArgument | None = None, allowance: AnalyzeArgument | None = None, cap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument of runs() must be a table")
        kind = "equal" if criterion is None else criterion.value
        if kind not in CRITERIA:
            raise ValueError(f"criterion must be one of {', '.join(CRITERIA)}, not {kind}")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        wanted = [key.value, *names(columns.value)]
        if missing := [c for c in wanted if c not in fields]:
            raise ValueError(f"the table of runs() has no column {', '.join(missing)}")
        if len(wanted) < 2:
            raise ValueError("runs() needs a column to compare")
        if cap is not None and not 1 <= cap.value:
            raise ValueError("cap must be 1 or more")
        if CRITERIA[kind].numeric and (odd := [c for c in wanted[1:] if not isinstance(fields[c], NumericType)]):
            raise ValueError(f"{kind} needs numbers; {', '.join(odd)} has none")
        CRITERIA[kind](len(wanted) - 1, 0.0 if allowance is None else float(allowance.value))
        values = [StructField(c, IntegerType() if kind == "mean" else fields[c]) for c in wanted[1:]]
        return AnalyzeResult(StructType([StructField(key.value, fields[key.value]), StructField("seq", LongType()), StructField("cnt", IntegerType()), *values]))

    def __init__(self) -> None:
        self.n = self.seq = 0
        self.criterion: Any = None

    def eval(self, row: Row, key: str, columns: str, criterion: str = "equal", allowance: float = 0.0, cap: int = CAP) -> Iterator[tuple]:
        if self.criterion is None:
            self.columns = names(columns)
            self.criterion = CRITERIA[criterion](len(self.columns), float(allowance))
            self.key = row[key]
        point = tuple(row[c] for c in self.columns)
        if self.n and self.n < cap and self.criterion.accepts(point):
            self.n += 1
            return
        if self.n:
            yield self._close()
        self.criterion.begin(point)
        self.n = 1

    def _close(self) -> tuple:
        self.seq += 1
        return self.key, self.seq - 1, self.n, *self.criterion.value()

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self._close()


def register(spark: SparkSession, name: str = "runs") -> None:
    """Make the table function known to a session's SQL."""
    spark.udtf.register(name, udtf(Runs))
