"""Reports out of stored sketches and months equal those over the whole history."""

import datetime as dt
import shutil

import pytest
from builders import customer, order, payment, plan_of, review, rows
from pyspark.sql import functions as F

from shopgauge.operators import churn, customers, increments
from shopgauge.plans import registry
from shopgauge.schema import FEATURES, LABEL, PERSON
from shopgauge.sources import testdata

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return testdata.star(spark, SF_DIR)


@pytest.fixture(scope="module")
def store(history, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    increments.add_months(history, folder)
    return folder


def full(star, days):
    return sorted(rows(churn.churn_features(star, days), PERSON, *FEATURES, LABEL))


@pytest.mark.parametrize("days", [30, 90, 400])
@pytest.mark.parametrize("months_back", [None, 0, 7])
def test_features_of_a_cutoff_equal_the_full_ones(spark, history, store, days, months_back):
    end = increments.cutoff(spark, store, days)
    base = None if months_back is None else increments.advance(spark, store, increments.month_of(end) - months_back)
    got = sorted(rows(increments.churn_features(spark, store, end, base), PERSON, *FEATURES, LABEL))
    assert got == full(history, days)


def test_later_cutoffs_read_only_the_months_from_their_base_on(spark, history, store, tmp_path):
    folder = str(tmp_path / "store")
    shutil.copytree(store, folder)
    months = sorted(r.month for r in spark.read.parquet(f"{folder}/months").select("month").distinct().collect())
    base = increments.advance(spark, folder, increments.month_of(increments.cutoff(spark, folder, 400)))
    for month in months:
        if month < base:  # what the base holds is not needed any more
            shutil.rmtree(f"{folder}/moments/month={month}", ignore_errors=True)
            shutil.rmtree(f"{folder}/kinds/month={month}", ignore_errors=True)
    for days in (400, 200, 90):
        end = increments.cutoff(spark, folder, days)
        if increments.month_of(end) > base:
            base = increments.advance(spark, folder, increments.month_of(end), base)
        facts = increments.person_facts(spark, folder, end, base)
        assert f">= {base})" in plan_of(facts).split("PartitionFilters")[1]
        got = sorted(rows(increments.churn_features(spark, folder, end, base), PERSON, *FEATURES, LABEL))
        assert got == full(history, days)


def small(make_star, *orders, payments=()):
    sessions = [customer("a1", "a", None), customer("a2", "a", "S2"), customer("b1", "b", "S1"), customer("n1", None, "S1")]
    sessions[-1] = ("n1", None, "0", "city", "S1")
    return make_star(customers=sessions, orders=list(orders), order_payments=list(payments), order_reviews=[review("r", "o1", 4)])


def test_added_months_replace_and_extend(spark, make_star, tmp_path):
    folder = str(tmp_path)
    first = [order("o1", "a1", "2024-01-31 23:00"), order("o2", "b1", "2024-01-05"), order("o3", "n1", "2024-01-06")]
    paid = [payment("o1", 10, "boleto"), payment("o1", 5, None), payment("o2", 7, "voucher")]
    increments.add_months(small(make_star, *first, payments=paid), folder)
    increments.add_months(small(make_star, *first, payments=paid), folder)  # repeated after a loss
    later = [order("o4", "a2", "2024-02-10"), order("o5", "a2", "2024-02-10"), order("o6", "b1", None), order("o7", "b1", "2024-02-11", status="shipped")]
    more = [payment("o4", 1, "boleto"), payment("o5", 2, "card")]
    increments.add_months(small(make_star, *later, payments=more), folder)
    whole = small(make_star, *first, *later, payments=paid + more)
    columns = [PERSON, "customer_state", "frequency", "last_obs_purchase", "first_purchase", "paid_cents", "type_count", "score_sum", "came_back"]
    for days in (0, 5, 20):
        end = increments.cutoff(spark, folder, days)
        got = sorted(rows(increments.person_facts(spark, folder, end), *columns), key=str)
        assert got == sorted(rows(churn.person_facts(whole, days, True, True), *columns), key=str)


def test_bases_that_reach_too_far_and_empty_stores_are_errors(spark, store, make_star, tmp_path):
    end = increments.cutoff(spark, store)
    with pytest.raises(ValueError, match="reaches beyond"):
        increments.person_facts(spark, store, end, increments.month_of(end) + 1)
    with pytest.raises(ValueError, match="not before"):
        increments.advance(spark, store, 100, 100)
    increments.add_months(make_star(), str(tmp_path))
    with pytest.raises(ValueError, match="no orders"):
        increments.cutoff(spark, str(tmp_path))
    with pytest.raises(ValueError, match="observation window"):
        increments.churn_features(spark, store, dt.datetime(1900, 1, 1))


def exact(star):
    return {(r[0], r[1]): r[2] for r in customers.cohort_retention_counts(star).collect()}


def test_two_halves_merge_to_the_sketches_of_the_whole(history):
    halves = [customers.month_sketches(half_of(history, half)) for half in range(2)]
    merged = customers.merged_months(halves[0].union(halves[1]))
    whole = customers.month_sketches(history)
    size = F.theta_sketch_estimate("sketch")
    assert sorted(rows(merged.select("month", size.alias("n")), "month", "n")) == sorted(rows(whole.select("month", size.alias("n")), "month", "n"))
    for sketches in (whole, halves[0].union(halves[1])):
        assert {(r[0], r[1]): r[2] for r in customers.cohorts_from_sketches(sketches).collect()} == exact(history)


def half_of(star, half):
    some = star.customers.where(F.pmod(F.hash(PERSON), F.lit(2)) == half)
    return type(star)(**{**star.tables(), "customers": some})


def test_sampled_sketches_keep_to_the_stated_error(spark):
    star = testdata.star(spark, "/root/testdata/sf0.01")
    log_size = 9  # 512 of 1,000 to 1,500 persons
    got = {(r[0], r[1]): r[2] for r in customers.cohorts_from_sketches(customers.month_sketches(star, log_size), log_size).collect()}
    want = exact(star)
    rate = 2**log_size / star.customers.select(PERSON).distinct().count()
    assert rate < 1 and set(got) <= set(want)
    off = [(got.get(key, 0) - n) / (n / rate) ** 0.5 for key, n in want.items()]
    assert sum(x * x for x in off) / len(off) < 1.5  # the mean square of standard errors
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.1


def test_no_sketches_give_no_cohorts(make_star):
    assert customers.cohorts_from_sketches(customers.month_sketches(make_star())).collect() == []


def test_joins_of_bucketed_tables_shuffle_nothing(spark):
    plan = plan_of(registry.bucketed_join(spark, SF_DIR), "simple")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
