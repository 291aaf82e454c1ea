"""Every named query against its SQL, on the smallest test tables."""

import pytest
from builders import plan_of

import __spark_entry__ as contract
import check
from shopgauge.plans import oracles, registry

SF_DIR = "/root/testdata/sf0.001"
WITH_PYTHON = {"proportion_test", "welch_t_test", "mean_ci", "power_proportion", "power_mean", "experiment_report",
               "significance_verdict"}
# The text queries have tests of their own.
WITH_SQL = sorted(oracles.all_oracles())


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(SF_DIR)


def check_plan(plan, python_allowed):
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert python_allowed or "Python" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:  # what is gathered comes out of an aggregate or a limit
            below = " ".join(lines[i + 1 : i + 6])
            assert "Aggregate" in below or "Limit" in below or "TakeOrdered" in below, below


@pytest.mark.parametrize("name", WITH_SQL)
def test_plan_is_sound_and_result_equals_the_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    check_plan(plan_of(df, "simple"), python_allowed=name in WITH_PYTHON)
    assert check.differences(df, con, contract.oracle_sql()[name]) == ""


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_queries_without_sql_are_learned_ones():
    learned = set(registry.learning_queries())
    assert set(registry.all_queries()) - set(oracles.all_oracles()) <= learned


def test_entry_is_lazy_and_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_declared_types_match_the_files(spark):
    from shopgauge.sources import testdata

    for name in testdata.TABLE_SCHEMAS:
        declared = testdata.table(spark, SF_DIR, name).schema
        found = spark.read.parquet(f"{SF_DIR}/{name}.parquet").schema
        assert declared == found, name
