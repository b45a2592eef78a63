"""The queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from rasterloom.llm import byte_bpe, centroids, exact_dedup, language_id, media, minhash, mixing, quality_crf, sentencepiece, suffix_dedup, token_counts, toxicity, whitening
from rasterloom.llm.common import table


def op1_language_id(spark, sf_dir):
    return language_id.op1(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_minhash(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op5_quality_crf(spark, sf_dir):
    return quality_crf.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark, sf_dir):
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark, sf_dir):
    return media.op6(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return centroids.op11(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark, sf_dir):
    return byte_bpe.op12(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.op13(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_minhash": op4_minhash,
    "op5_quality_crf": op5_quality_crf,
    "op7_toxicity": op7_toxicity,
    "op6_media_columns": op6_media_columns,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroids": op11_centroids,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_centroids": centroids.SQL,
}
