"""The pipeline's stages against plain code, and the registered queries against their SQL."""

import hashlib
import re

import public_tokenizers
import pytest
import tokenizers

import check
import corpus_pipeline
from shopgauge.llm import oracles, queries, simhash_mih, source_mix, toxicity_gru
from shopgauge.llm.tables import DOCUMENT_COLUMNS, table
from shopgauge.session import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, beginning with the documents."""
    out = [table(spark, SF_DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*DOCUMENT_COLUMNS).collect()), key=repr)


def test_all_but_the_last_stage_return_documents(stages):
    assert all(df.columns == DOCUMENT_COLUMNS for df in stages[1:-1])


def test_toxicity_drops_what_the_network_rejects(spark, stages):
    scored = toxicity_gru.scored(stages[0], table(spark, SF_DIR, "labels"))
    rejected = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert rejected and rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in rejected]


def test_exact_dedup_keeps_the_smallest_id(stages):
    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in stages[2].collect()} == set(first.values()) and stages[2].count() == len(first)


def test_near_dedup_keeps_one_of_each_component(stages):
    docs = sorted((r.doc_id, simhash_mih.fingerprint(r.text or "")) for r in stages[2].collect())
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in docs:
        for j, b in docs:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r.doc_id for r in stages[3].collect()} == {find(i) for i, _ in docs}


def test_mixing_repeats_documents_as_the_mix_says(stages):
    want = sorted(i for r in source_mix.mix(stages[3]).collect() for i in [r.doc_id] * r.copies)
    assert sorted(r.doc_id for r in stages[4].collect()) == want


def test_the_last_stage_encodes_every_row(stages):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = []
    for r in stages[4].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect()) == sorted(want)


def test_run_returns_what_the_stages_return(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, stages[-1].collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_queries_equal_their_sql(spark, name):
    con = check.oracle_connection(SF_DIR)
    assert check.differences(queries.all_queries()[name](spark, SF_DIR), con, oracles.all_oracles()[name]) == ""


def test_every_operator_is_registered():
    names = list(queries.all_queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(oracles.all_oracles()) <= set(names)


@pytest.mark.parametrize("name", ["op4_source_mix", "op6_spotsigs"])
def test_native_queries_run_no_python(spark, name):
    df = queries.all_queries()[name](spark, SF_DIR)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
