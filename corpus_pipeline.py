"""From raw documents to token ids: quality, exact and near duplicates, mixing, encoding.

Each stage works on all that the one before kept and is written as Parquet in between. run() does the same in the
session's shared folder. SQL can express neither the classifier nor the hashes, so ORACLE_SQL is None and the tests
hold each stage against plain Python.

Cases, in all stages: a null text is an empty one; an empty table gives no rows; other columns pass as they are, whatever
their names. A row without an id cannot be told from others by the stages that choose among documents, so it stays in
them. Rows repeated with one id and text are one document: the exact stage leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import exact_dedup, minhash, mixing, quality_crf, sentencepiece
from rasterloom.llm.common import keep, table, without

ORACLE_SQL = None
#: Near copies share at least this percent of their shingles; the query op4_minhash has its own threshold.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among docs."""
    return quality_crf.filter_good(docs, quality_crf.learn(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original, then the smallest id."""
    groups = keep(exact_dedup.exact_groups(docs).select("doc_id", "kept").filter("doc_id IS NOT NULL"))
    out = without(docs, groups.filter("NOT kept"))
    kept = groups.filter("kept").groupBy("doc_id").count().filter("count > 1")
    if kept.isEmpty():
        return out
    again = kept.select("doc_id")  # rows repeated with one id: one of them, which are alike but for their other columns
    one = out.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return without(out, again).unionByName(one)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the document with the smallest id."""
    return without(docs, minhash.near_groups(docs, percent=NEAR_PERCENT).filter("NOT kept AND doc_id IS NOT NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics approach their target weights."""
    return without(docs, mixing.mix(docs).filter("NOT sampled AND doc_id IS NOT NULL"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
