"""A training corpus from raw documents: five stages, each written and read again before the next one.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopgauge.llm import bpe_rounds, simhash_mih, source_mix, stream_dedup, toxicity_gru
from shopgauge.llm.tables import DOCUMENT_COLUMNS, table
from shopgauge.session import materialize

VOCABULARY = "word_bpe_49k.json"
#: SQL cannot express the trained network or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject."""
    return toxicity_gru.accepted(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text, the one with the smallest doc_id."""
    return stream_dedup.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash_mih.one_per_group(docs.select(*DOCUMENT_COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return source_mix.mixed_documents(docs.select(*DOCUMENT_COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, a row per document of the mix."""
    return bpe_rounds.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", mixing),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
