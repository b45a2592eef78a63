"""Queries of the dictionary coders as streams, and of the search that one of them is made of."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import lz
from rasterloom.plans.queries import query
from rasterloom.sources.shared import new_folder
from rasterloom.sources.tables import doc_bytes
from rasterloom.streaming import coders

#: Bytes of a block, and the blocks of a text that come in each wave but the last, which brings the rest.
BLOCK, WAVES = 2048, (1,)


def in_waves(blocks: DataFrame, coder: Callable[[DataFrame], DataFrame], waves: tuple[int, ...], folder: str) -> DataFrame:
    """What a coder's stream gives for blocks that come in waves. The query ends after each wave and is started again from
    its checkpoint for the next one."""
    spark, first = blocks.sparkSession, 0
    wave = F.lit(len(waves))
    for i, n in reversed(list(enumerate(waves))):
        first = sum(waves[: i + 1])
        wave = F.when(F.col("block") < first, i).otherwise(wave)
    schema = blocks.schema
    for i in range(len(waves) + 1):
        blocks.filter(wave == i).write.mode("append").parquet(f"{folder}/blocks")
        stream = coder(spark.readStream.schema(schema).parquet(f"{folder}/blocks"))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
        writer.trigger(availableNow=True).start(f"{folder}/symbols").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/symbols")


_DECODED = (
    "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(encode(coalesce(text, ''))) "
    "AS md5, true AS as_batch FROM documents WHERE coalesce(text, '') <> ''"
)


def _compared(symbols: DataFrame, data: DataFrame, of: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, n_bytes and md5 of what the stream's symbols (doc_id, place, wire) decode to, and whether they are the batch's.

    The symbols of a text are gathered before its bytes are joined to them, so these are dealt once and not once a symbol."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, same = [], []
            for wire, text in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                wire = b"".join(wire)
                back.append(decode(wire))
                same.append(wire == of(text))
            md5 = [hashlib.md5(b).hexdigest() for b in back]
            yield pa.record_batch([batch.column(0), pa.array(map(len, back), pa.int64()), pa.array(md5, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_bytes", "md5", "as_batch"])

    wires = symbols.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "wire"))), lambda s: s["wire"]).alias("wires"))
    kind = dict(data.dtypes)["doc_id"]
    return wires.join(data.select("doc_id", "data"), "doc_id").select("doc_id", "wires", "data").mapInArrow(check, f"doc_id {kind}, n_bytes long, md5 string, as_batch boolean")


def _texts(spark, sf) -> DataFrame:
    return doc_bytes(spark, sf).filter("doc_id IS NOT NULL")


@query("sf_zipdict_stream", _DECODED)
def sf_zipdict_stream(spark, sf):
    """Texts in blocks through the pair coder with its dictionary in the state store, and a restart in between."""
    data = _texts(spark, sf)
    got = in_waves(coders.in_blocks(data, BLOCK), coders.stream_pair_bytes, WAVES, new_folder(spark, "pairs"))
    wire = got.select("doc_id", F.col("start").alias("place"), "wire")
    return _compared(wire, data, lambda x: lz.dict_bytes(lz.dict_symbols(x)), lambda w: lz.dict_decode(lz.dict_parse(w)))


@query("sf_zipback_stream", _DECODED)
def sf_zipback_stream(spark, sf):
    """Texts in blocks through the look-back coder with its ring in the state store, and a restart in between."""
    data = _texts(spark, sf)
    got = in_waves(coders.in_blocks(data, BLOCK), coders.stream_copies, WAVES, new_folder(spark, "copies"))
    le = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    copy = F.unhex(F.concat(le(F.col("size") + 0x8000), le(F.col("back"))))
    wire = F.when(F.col("explicit").isNull(), copy).otherwise(F.concat(F.unhex(le(F.col("size"))), F.col("explicit")))
    rows = got.select("doc_id", F.col("seq").alias("place"), wire.alias("wire"))
    return _compared(rows, data, lambda x: lz.back_bytes(lz.back_symbols(x)), lambda w: lz.back_decode(lz.back_parse(w)))


EVERY_MATCH = """
    WITH {BYTES},
    own AS (SELECT * FROM byts WHERE doc_id % 100 = 0),
    g AS (
        SELECT doc_id, pos, string_agg(lpad(hex(byte), 2, '0'), '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS gram,
               max(pos) OVER (PARTITION BY doc_id) + 1 AS n
        FROM own
    ),
    pairs AS (
        SELECT a.doc_id, a.pos, a.pos - b.pos AS back, a.n
        FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.pos < a.pos AND a.pos - b.pos <= 65535
        WHERE length(a.gram) = 12
    ),
    runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, back ORDER BY pos) AS run FROM pairs),
    sized AS (
        SELECT doc_id, pos, back, least(max(pos) OVER (PARTITION BY doc_id, back, run) - pos + 6, back, 32767) AS size FROM runs
    )
    SELECT doc_id, pos, max(size) AS size, max_by(back, size * 100000 + back) AS back FROM sized WHERE size >= 6 GROUP BY ALL
"""


@query("zb_index", EVERY_MATCH)
def zb_index(spark, sf):
    """Of every place of the texts whose id is divisible by 100 the longest copy before it, the oldest of equals."""
    return coders.matches(doc_bytes(spark, sf).filter("doc_id % 100 = 0"))
