"""What the corpus operators share: reading tables, shared storage, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.shared import new_folder

#: The white space of every word rule here: space and 09-0D.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that a worker takes at once; its arrays are some thirty times that.
PORTION = 2 << 20
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, **seen: Column) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what lies before. What was shuffled for the
    table is of no further use and its disk is freed at once. Aggregates in seen are taken while it is written and
    stand in the result's `seen`."""
    spark, schema = df.sparkSession, df.schema
    observed = Observation()
    if seen:
        df = df.observe(observed, *(c.alias(k) for k, c in seen.items()))
    path = new_folder(spark, "kept")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._kept_path = path
    out.seen = observed.get if seen else {}
    return out


def discard(*kept: DataFrame) -> None:
    """Delete what keep() wrote, once other kept tables have all that is needed of it."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Marks take at most so many bits (2 ** MARK_BITS / 8 bytes are 16 MB), however many values there are.
MARK_BITS = 27


class Marks:
    """A lossy set of 64-bit hashes, one bit for each, for leaving rows out before an exchange; an exact join follows it.

    It is bounded by MARK_BITS, so it can be broadcast; with more values than that suits, more rows pass and the join
    does the work alone."""

    def __init__(self, hashes: DataFrame, column: str, count: int):
        """hashes: a table with the 64-bit hashes in a column; count: its rows."""
        self.size = 1 << min(MARK_BITS, max(16, (32 * count).bit_length()))
        at = F.col(column).bitwiseAND(F.lit(self.size - 1)) + 1
        rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
        self.bits = np.zeros(self.size // 8, np.uint8)
        for r in rows.collect():
            self.bits[(r["k"] - 1) << 12 : r["k"] << 12] = np.frombuffer(r["b"], np.uint8)

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.int64(self.size - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """df but for the rows whose id stands in ids; a row without an id stays.

    The ids are marked in a bitmap, a table of at most 2 ** MARK_BITS / 8 bytes that can be broadcast. Rows that are not
    marked pass where they are read, so only the others, whole texts as they may be, are shuffled for the exact join. More
    ids than bits would mark nearly all rows, and then the join does the work alone."""
    gone = keep(ids.select(F.col(column).alias("id")).distinct(), rows=F.count(F.lit(1)))
    size = 1 << min(MARK_BITS, max(16, (32 * gone.seen["rows"]).bit_length()))
    columns = [df[c] for c in df.columns]
    if gone.seen["rows"] > size:
        return df.join(gone, df[column] == gone["id"], "left_anti").select(columns)
    at = lambda c: F.xxhash64(c.cast("string")).bitwiseAND(F.lit(size - 1))
    place = at(gone["id"]) + 1
    bits = keep(gone.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")))
    mine = at(df[column])
    position = F.bitmap_bit_position(mine + 1)
    byte = F.conv(F.hex(F.substr(bits["b"], F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, position.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    told = df.join(F.broadcast(bits), F.bitmap_bucket_number(mine + 1) == bits["k"], "left")
    clear, rest = (told.filter(c).select(columns) for c in (~marked, marked))
    return clear.unionAll(rest.join(gone, rest[column] == gone["id"], "left_anti").select(*(rest[c] for c in df.columns)))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def trim() -> None:
    """Give what this process has freed back to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if give := getattr(_LIBC, "malloc_trim", None):  # glibc only
        give(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text at most, so that working memory follows neither row count nor length."""
    trim()  # what the worker's task before left
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(n * max_bytes / max(size, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)
    trim()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
