"""The operators of this folder as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopgauge.llm import (
    bpe_rounds, cover_codes, langid_crf, pii_boosting, qd_whitening, quality_bt, simhash_mih, source_mix, spotsigs, stream_dedup,
    superkmers, toxicity_gru, warc_revisits,
)
from shopgauge.llm.tables import table

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_crf.predicted(table(spark, sf_dir, "documents"))


def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.deduplicated_archive(table(spark, sf_dir, "pages"))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_groups(table(spark, sf_dir, "documents"))


def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.removed_windows(table(spark, sf_dir, "documents"))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rounds.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.near_duplicates(table(spark, sf_dir, "documents"))


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qd_whitening.components(table(spark, sf_dir, "embeddings"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_codes.compressed(table(spark, sf_dir, "embeddings"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boosting.spans(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_quality_bradley_terry": quality,
        "op2_language_crf": language,
        "op3_warc_revisits": revisits,
        "op4_source_mix": mixing,
        "op5_stream_dedup": exact_dedup,
        "op6_spotsigs": spot_signatures,
        "op7_superkmer_dedup": substring_dedup,
        "op8_bpe_rounds": bpe,
        "op9_toxicity_gru": toxicity,
        "op10_simhash_mih": simhash,
        "op11_qd_whitening": whitening,
        "op12_cover_tree_codes": vector_codes,
        "op13_pii_boosting": personal_data,
        "pipeline": corpus_pipeline.run,
    }
