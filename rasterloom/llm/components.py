"""Connected components of an edge table by alternating large and small stars, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, keep


def _lowest(near: DataFrame) -> DataFrame:
    return near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return near.join(_lowest(near), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(near)
    return near.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node on an edge. Rounds grow with the logarithm of the
    longest path; each ends in a table in the shared folder, and only one sum and one count reach the driver, which
    are taken while that table is written."""
    edges = keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct())
    state = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    before = None
    while True:
        spread = keep(_large(edges))
        discard(edges)
        edges = keep(_small(spread), **state)
        discard(spread)
        if edges.seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
        before = edges.seen
