"""Report files: one CSV of results for each codec, scan exports, and the tables that plots are drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "name string, compressed_size long, compression_ratio double, error double"


def display_name(path: Column) -> Column:
    """A path's base name without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def codec_group(name: Column) -> Column:
    return F.split(name, "_")[0]


def under_output(path: Column, extension: str) -> Column:
    return F.concat(F.lit("output/"), display_name(path), F.lit(f".{extension}"))


def write_results(results: DataFrame, path: str) -> None:
    """One folder of CSV parts with a header."""
    results.select("name", "compressed_size", "compression_ratio", "error").write.mode("overwrite").option("header", True).csv(path)


def write_failures(failed: DataFrame, path: str) -> None:
    """Names and messages of files that failed."""
    failed.select("name", "error_msg").write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files under a path but scan exports and failures, with display_name; a missing error column reads as null.

    A file's path is known before it is opened, so those that are left out are not read."""
    got = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(RESULTS).csv(path).withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+\.csv)(/part-[^/]*)?$", 1))
    return got.filter(~F.col("file").endswith(".hilbert.csv") & ~F.col("file").endswith(".failed.csv")).withColumn("display_name", display_name(F.col("file"))).drop("file")


def write_scan(scan: DataFrame, path: str) -> None:
    """A scan export: red, green, blue in the order of hidx."""
    scan.orderBy("img_id", "hidx").select("img_id", "hidx", F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue")).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
