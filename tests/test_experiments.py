import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from shopgauge.functions import tails
from shopgauge.operators import experiments as x
from shopgauge.schema import EXPERIMENT_RECORD


def units(spark, *arms, name="e"):
    data = [(name, f"{arm}{i}", arm, float(v)) for arm, values in arms for i, v in enumerate(values)]
    return spark.createDataFrame(data, "experiment string, unit_id string, arm string, outcome double")


def rates(spark, c, nc, t, nt, name="e"):
    return units(spark, ("control", [1] * c + [0] * (nc - c)), ("treatment", [1] * t + [0] * (nt - t)), name=name)


def test_corrected_chi_square(spark):
    row = x.proportion_statistics(rates(spark, 20, 100, 30, 100)).first()
    assert row.test_statistic == pytest.approx(2.16, abs=1e-12)
    assert row.p_value == pytest.approx(0.141645, abs=1e-6)


def test_interval_lift_mde_and_power_of_rates(spark):
    row = x.proportion_statistics(rates(spark, 20, 100, 30, 100)).first()
    z, z80 = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)
    se = math.sqrt(0.2 * 0.8 / 100 + 0.3 * 0.7 / 100)
    assert row.ci_lower == pytest.approx(0.1 - z * se)
    assert row.relative_lift_pct == pytest.approx(50)
    assert row.mde == pytest.approx((z + z80) * math.sqrt(2 * 0.2 * 0.8 / 100))
    se0 = math.sqrt(2 * 0.25 * 0.75 / 100)
    assert row.statistical_power == pytest.approx(NormalDist().cdf((0.1 - z * se0) / se), abs=1e-12)


def test_no_successes_at_all(spark):
    row = x.proportion_report(rates(spark, 0, 10, 0, 10)).first()
    assert (row.relative_lift_pct, row.test_statistic, row.p_value) == (0.0, None, None)


def test_welch_sign_degrees_and_interval(spark):
    row = x.mean_statistics(units(spark, ("control", [1, 2, 3, 4]), ("treatment", [4, 6, 8, 10, 12, 20]))).first()
    assert row.absolute_lift > 0 > row.test_statistic
    assert 3 < row.degrees_of_freedom < 8
    assert row.t_critical == pytest.approx(3.182446, abs=1e-6)  # 3 degrees of freedom
    assert row.ci_upper - row.absolute_lift == pytest.approx(row.t_critical * row.standard_error)


@pytest.mark.parametrize(
    "t, df, p", [(2.228138852, 10, 0.05), (1.959963985, 1e9, 0.05), (12.7062047, 1, 0.05), (0.0, 5, 1.0), (63.657, 1, 0.01)]
)
def test_t_tail(t, df, p):
    assert tails.t_two_sided(t, df) == pytest.approx(p, abs=1e-6)
    assert tails.t_two_sided(-t, df) == tails.t_two_sided(t, df)


@pytest.mark.parametrize("df", [1e10, 1e12])
def test_t_tail_of_very_large_samples(df):
    assert tails.t_two_sided(1.959963984540054, df) == pytest.approx(0.05, abs=1e-8)


@pytest.mark.parametrize("df", [1, 2.5, 30, 2999, 1e6])
def test_t_quantile_inverts_the_tail(df):
    assert tails.t_two_sided(tails.t_quantile(0.975, df), df) == pytest.approx(0.05, abs=1e-10)


@pytest.fixture(scope="module")
def report(spark):
    draw = random.Random(42)
    flips = lambda p, n: [int(draw.random() < p) for _ in range(n)]
    spend = lambda m, s, n: [max(5.0, draw.gauss(m, s)) for _ in range(n)]
    checkout = units(spark, ("control", flips(0.032, 5000)), ("treatment", flips(0.038, 5000)), name="checkout")
    email = units(spark, ("control", flips(0.21, 10000)), ("treatment", flips(0.23, 10000)), name="email")
    discount = units(spark, ("control", spend(85, 25, 3000)), ("treatment", spend(92, 28, 3000)), name="discount")
    return x.experiment_report(checkout.unionByName(email), discount).collect()


def test_report_has_one_record_per_experiment(report):
    assert len(report) == 3
    assert report[0].__fields__ == EXPERIMENT_RECORD
    kinds = {r.experiment_name: r.test_type for r in report}
    assert kinds == {"checkout": "chi_square", "email": "chi_square", "discount": "t_test"}


def test_metrics_of_an_experiment_have_records_of_their_own(spark):
    both = [rates(spark, 20, 100, t, 100).withColumn("metric", F.lit(m)) for t, m in ((30, "opens"), (21, "clicks"))]
    records = x.proportion_report(both[0].unionByName(both[1])).collect()
    assert {(r.experiment_name, r.metric_name, r.treatment_mean) for r in records} == {
        ("e", "opens", 0.3), ("e", "clicks", 0.21),
    }
    assert x.proportion_report(rates(spark, 20, 100, 30, 100)).first().metric_name == "e"


def test_report_properties(report):
    for r in report:
        assert 0 <= r.p_value <= 1
        assert 0 <= r.statistical_power <= 1
        assert r.ci_lower <= r.absolute_lift <= r.ci_upper
        assert r.mde > 0
        assert r.is_significant == (r.p_value < 0.05)


def test_discount_lifts(report):
    row = next(r for r in report if r.experiment_name == "discount")
    assert row.treatment_mean > row.control_mean and row.absolute_lift > 0 and row.is_significant


def test_verdict(spark):
    sure = x.significance_verdict(x.proportion_report(rates(spark, 100, 1000, 200, 1000))).first()
    assert sure.verdict.startswith("We reject") and "The 100% lift is real." in sure.verdict
    unsure = x.significance_verdict(x.proportion_report(rates(spark, 20, 100, 21, 100))).first()
    assert unsure.verdict.startswith("We fail to reject") and "lift of 5% may" in unsure.verdict


def test_sample_size_rule(spark):
    grid = x.sample_size_grid(rates(spark, 5, 100, 9, 100))
    got = {r.lift_pct: r.per_arm for r in grid.collect()}
    base, lifted = 0.05, 0.05 * 1.2
    middle = (base + lifted) / 2
    spread = 1.96 * math.sqrt(2 * middle * (1 - middle)) + 0.84 * math.sqrt(base * (1 - base) + lifted * (1 - lifted))
    assert got[20] == math.ceil(spread**2 / (lifted - base) ** 2)
    assert len(got) == 96


def test_sample_size_beyond_certainty_is_null(spark):
    got = {r.lift_pct: r.per_arm for r in x.sample_size_grid(rates(spark, 60, 100, 9, 100)).collect()}
    assert got[66] is not None and got[67] is None
    nothing = {r.per_arm for r in x.sample_size_grid(rates(spark, 0, 100, 9, 100)).collect()}
    assert nothing == {None}


def test_other_arms_are_ignored(spark):
    mixed = units(spark, ("control", [0, 1]), ("treatment", [1, 1]), ("holdout", [5, 5]))
    assert {r.arm for r in x.arm_statistics(mixed).collect()} == {"control", "treatment"}
