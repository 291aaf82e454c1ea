"""Ids that no double holds, beside null ids and null other columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from shopgauge.llm import (
    bpe_rounds, langid_crf, pii_boosting, quality_bt, simhash_mih, source_mix, spotsigs, stream_dedup, superkmers, toxicity_gru,
)
from shopgauge.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"
IDS = [9007199254740993, None, 9007199254740995, (1 << 63) - 2, 7]


@pytest.fixture(scope="module")
def docs(spark):
    """All in one batch; n_chars has nulls too, and one value that no double holds."""
    shared = " ".join(f"word{i}" for i in range(60))
    rows = [(doc_id, f"{shared} and text number {i}", "en", "web", None if i == 2 else 9007199254740993) for i, doc_id in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_every_operator_returns_the_ids_it_got(spark, docs):
    labels = table(spark, SF_DIR, "labels")
    known = table(spark, SF_DIR, "documents").unionByName(docs)
    field = langid_crf.learn(known)
    results = {
        "quality": quality_bt.scored(docs, labels), "language": langid_crf.predicted(docs, field), "spans": langid_crf.word_spans(docs, field),
        "mix": source_mix.mix(docs), "exact": stream_dedup.exact_groups(docs), "spots": spotsigs.edited_likeness(docs),
        "passages": superkmers.removed_windows(docs), "bpe": bpe_rounds.digests(docs, public_tokenizers.path("word_bpe_49k.json")),
        "encoded": bpe_rounds.encoded(docs, public_tokenizers.path("word_bpe_49k.json")), "toxicity": toxicity_gru.scored_rows(docs, None, ["doc_id"]),
        "simhash": simhash_mih.near_duplicates(docs), "prints": simhash_mih.fingerprints(docs), "private": pii_boosting.spans(docs),
    }
    for name, result in results.items():
        assert sorted(map(str, IDS)) == sorted(str(r.doc_id) for r in result.select("doc_id").collect()), name


def test_accepted_documents_keep_all_columns(spark, docs):
    kept = toxicity_gru.accepted(docs, table(spark, SF_DIR, "labels"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_stages_of_the_pipeline_keep_ids(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = {str(r.doc_id) for r in stage(spark, docs, SF_DIR).collect()}
        assert kept and kept <= set(map(str, IDS)), name
