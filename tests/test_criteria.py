"""Runs as a table function: criteria, caps, partitions, refusals."""

import random

import pytest

from rasterloom.operators import criteria
from rasterloom.operators.sequence import MeanRuns

SCAN = [3, 3, 5, 7, 6, 6, 8, 8, 7, 7, 7, 8, 9, 9, 8, 9]


@pytest.fixture(scope="module")
def sql(spark):
    criteria.register(spark)
    r = random.Random(3)
    rows = [("scan", i, v, "x") for i, v in enumerate(SCAN)] + [("flat", i, 7, "x") for i in range(600)]
    rows += [("noise", i, r.randint(0, 5), r.choice("ab")) for i in range(900)] + [(None, 0, 1, None), (None, 1, 1, None)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "k string, pos int, v int, w string").repartition(3).createOrReplaceTempView("criteria_rows")

    def run(arguments, columns="v", where="true"):
        got = spark.sql(f"SELECT * FROM runs(TABLE(SELECT * FROM criteria_rows WHERE {where}) PARTITION BY k ORDER BY pos, key => 'k', columns => '{columns}'{arguments})").collect()
        out = {}
        for r in sorted(got, key=lambda r: (str(r.k), r.seq)):
            out.setdefault(r.k, []).append((r.cnt, *r[3:]))
            assert r.seq == len(out[r.k]) - 1
        return out

    return run


def test_equal(sql):
    got = sql("")
    assert got["scan"] == [(2, 3), (1, 5), (1, 7), (2, 6), (2, 8), (3, 7), (1, 8), (2, 9), (1, 8), (1, 9)]
    assert got["flat"] == [(255, 7), (255, 7), (90, 7)] and got[None] == [(2, 1)]
    assert sql(", cap => 1000")["flat"] == [(600, 7)]
    assert sum(n for n, *_ in sql("", "v,w")["noise"]) == 900


def test_mean(sql):
    got = sql(", criterion => 'mean', allowance => 1.0")
    assert got["scan"] == [(2, 3), (1, 5), (3, 6), (6, 8), (4, 9)] and [n for n, _ in got["flat"]] == [255, 255, 90]
    noise = [r.v for r in sorted(_rows(), key=lambda r: r.pos)]
    assert got["noise"] == [(n, m[0]) for n, m in MeanRuns(1.0, 1).runs((v,) for v in noise)]


def _rows():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sql("SELECT * FROM criteria_rows WHERE k = 'noise'").collect()


def test_near(sql):
    assert sql(", criterion => 'near', allowance => 2")["scan"] == [(3, 3), (13, 7)]


def test_no_rows(sql):
    assert sql("", where="false") == {}


@pytest.mark.parametrize("arguments, columns, why", [(", criterion => 'odd'", "v", "must be one of"), (", criterion => 'mean'", "w", "needs numbers"), (", criterion => 'mean', allowance => -1.0", "v", "not negative"), (", allowance => 1.0", "v", "no allowance"), (", cap => 0", "v", "1 or more"), ("", "z", "no column z"), ("", "", "to compare")])
def test_refusals(sql, arguments, columns, why):
    with pytest.raises(Exception, match=why):
        sql(arguments, columns)
