"""Queries against their SQL counterparts, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rasterloom.plans import exact, specs, streams  # noqa: F401  they register their queries
from rasterloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") and getattr(v, "ndim", 0) == 0 else v
    if v is pd.NA or v is pd.NaT:
        return "None"
    if isinstance(v, bool | str | bytes) or v is None:
        return str(v)
    if hasattr(v, "__len__"):
        return str([plain(x) for x in v])
    if isinstance(v, int) or v == v and float(v).is_integer() and abs(v) < 2**53:
        return str(int(v))
    return "None" if v != v else f"{float(v):.9g}"


def same(df, other):
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df) == rows(other)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, db, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), db.sql(plans.ORACLE_SQL[name]).df())


def test_every_survey_query_has_a_counterpart():
    """But for dictionaries and clusters, which SQL cannot make."""
    without = {"km_cluster", "cd_cluster_colors", "cd_voronoi", "cd_hilbert_zip", "cd_zip_dict", "cd_zip_back", "sf_zipdict", "sf_zipback", "ag_trie_stats"}
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == without


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
