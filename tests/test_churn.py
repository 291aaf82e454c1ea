import pytest
from builders import customer, order, payment, review, rows
from pyspark.sql import functions as F

from shopgauge.operators import churn, scoring
from shopgauge.schema import FEATURES, LABEL, PERSON


@pytest.fixture
def star(make_star):
    """Last order 2024-06-29 00:00, so the observation window ends 2024-03-31 00:00."""
    return make_star(
        customers=[customer("a1", "a", None), customer("a2", "a", "S2"), customer("b1", "b", "S1"),
                   customer("c1", "c", "S3"), customer("d1", "d", "S9"), customer("e1", "e", None)],
        orders=[
            order("o1", "a1", "2024-01-01 23:00"), order("o2", "a2", "2024-01-03 01:00"),
            order("o3", "a2", "2024-03-31 00:00:00"),
            order("o4", "b1", "2024-03-30 23:59:59"), order("o5", "b1", "2024-03-31 00:00:01"),
            order("o6", "c1", "2024-02-01"), order("o7", "d1", "2024-06-29"),
            order("o8", "e1", "2024-01-10"), order("o9", "e1", "2024-01-11", status="canceled"),
        ],
        order_payments=[
            payment("o1", 10, "boleto", 1), payment("o1", 20, "voucher", 3, 2), payment("o2", 30, "boleto", 2),
            payment("o4", 5), payment("o5", 500, "voucher"), payment("o8", 1),
        ],
        order_reviews=[review("r1", "o1", 4), review("r2", "o2", None), review("r3", "o5", 1)],
    )


def by_person(df, *columns):
    return {r[0]: tuple(r[1:]) for r in rows(df, PERSON, *columns)}


def test_split_closes_the_observation_window_at_the_cutoff(star):
    windows = dict(rows(churn.temporal_split(star), "order_id", "window"))
    assert windows == {"o1": "obs", "o2": "obs", "o3": "obs", "o4": "obs", "o5": "pred", "o6": "obs", "o7": "pred",
                       "o8": "obs"}


def test_order_features(star):
    got = by_person(churn.order_features(star), "customer_state", "frequency")
    assert got == {"a": ("S2", 3), "b": ("S1", 1), "c": ("S3", 1), "e": (None, 1)}


def test_payment_features_use_payment_rows_and_zero_for_none(star):
    got = by_person(churn.payment_features(star), "monetary", "avg_order_value", "avg_installments", "payment_type_count")
    assert got == {"a": (60.0, 20.0, 2.0, 2), "b": (5.0, 5.0, 1.0, 1), "c": (0.0, None, None, 0), "e": (1.0, 1.0, 1.0, 1)}


def test_payment_types_are_counted(star):
    got = by_person(churn.payment_features(star), "payment_type_count")
    assert got == {"a": (2,), "b": (1,), "c": (0,), "e": (1,)}


def test_review_features_default(star):
    got = by_person(churn.review_features(star), "avg_review_score", "review_count")
    assert got == {"a": (4.0, 1), "b": (3.0, 0), "c": (3.0, 0), "e": (3.0, 0)}


def test_tenure_and_gap(star):
    got = by_person(churn.tenure_and_gap(star), "tenure_days", "avg_days_between_orders")
    assert got == {"a": (89, 44.5), "b": (0, 365.0), "c": (0, 365.0), "e": (0, 365.0)}


def test_label(star):
    assert by_person(churn.churn_label(star), LABEL) == {"a": (1,), "b": (0,), "c": (1,), "e": (1,)}


def test_state_codes_follow_the_sorted_states_of_these_persons(star):
    assert by_person(churn.state_encoding(star), "state_encoded") == {"a": (1,), "b": (0,), "c": (2,), "e": (-1,)}


def test_features_drop_incomplete_persons_and_keep_the_key(star):
    df = churn.churn_features(star)
    assert df.columns == [PERSON, *FEATURES, LABEL]
    assert set(by_person(df)) == {"a", "b", "e"}
    check = churn.churn_rate_check(df).first()
    assert (check.customers, check.churn_rate_pct, check.in_band) == (3, 66.6667, False)


def test_nothing_observed_is_an_error(make_star):
    star = make_star(customers=[customer("a")], orders=[order("o1", "a", "2024-01-01", status="shipped")])
    with pytest.raises(ValueError, match="observation window"):
        churn.require_observations(star)


def request(spark, **given):
    values = {"frequency": 3, "monetary": 450.0, "avg_order_value": 150.0, "avg_installments": 2.5,
              "payment_type_count": 2, "avg_review_score": 4.0, "review_count": 3, "tenure_days": 180,
              "avg_days_between_orders": 60.0, "state_encoded": 12, **given}
    kinds = ", ".join(
        f"{n} {'double' if n in ('monetary', 'avg_order_value', 'avg_installments', 'avg_review_score', 'avg_days_between_orders') else 'long'}"
        for n in values
    )
    return spark.createDataFrame([tuple(values.values())], kinds)


def test_request_defaults_differ_from_feature_defaults(spark):
    asked = request(spark, avg_review_score=None, review_count=None, tenure_days=None, avg_days_between_orders=None,
                    state_encoded=None)
    row = churn.validate_features(asked).first()
    assert row.is_valid
    assert (row.avg_review_score, row.review_count, row.tenure_days, row.avg_days_between_orders, row.state_encoded) \
        == (3.0, 0, 0, 90.0, 0)


def test_requests_out_of_range_are_rejected_with_reasons(spark):
    bad = request(spark, frequency=0, avg_review_score=5.1, monetary=None)
    accepted, rejected = churn.split_requests(bad)
    assert accepted.count() == 0
    assert rejected.first().violations == ["frequency: below 1", "monetary: missing", "avg_review_score: above 5"]


PROBABILITIES = [0.0, 0.1, 0.3, 0.4, 0.5, 0.7, 0.95, 1.0]


@pytest.fixture
def scored(spark):
    data = [(f"p{i}", p, 2, 10.005, 1.25) for i, p in enumerate(PROBABILITIES)]
    return spark.createDataFrame(data, f"{PERSON} string, probability double, frequency long, monetary double, "
                                       "avg_days_between_orders double")


def test_two_band_rules(scored):
    got = by_person(scoring.risk_bands(scored), "batch_band", "single_band", "is_churned")
    assert [got[f"p{i}"] for i in range(8)] == [
        (None, "LOW", False), ("LOW", "LOW", False), ("LOW", "LOW", False), ("LOW", "MEDIUM", False),
        ("MEDIUM", "MEDIUM", True), ("MEDIUM", "HIGH", True), ("HIGH", "HIGH", True), ("HIGH", "HIGH", True),
    ]


def test_histogram_closes_its_last_bin_and_reports_empty_ones(scored):
    got = rows(scoring.risk_histogram(scored), "range", "count", "tier")
    assert [n for _, n, _ in got] == [1, 1, 0, 1, 1, 1, 0, 1, 0, 2]
    assert got[0] == ("0.0-0.1", 1, "LOW") and got[3][2] == "LOW" and got[4][2] == "MEDIUM" and got[9][2] == "HIGH"


def test_high_risk_is_ranked(scored):
    got = rows(scoring.high_risk(scored, top=3), "customer_rank", PERSON, "churn_probability", "risk_level")
    assert got == [(1, "p7", 1.0, "HIGH"), (2, "p6", 0.95, "HIGH"), (3, "p5", 0.7, "MEDIUM")]


def test_histogram_of_nothing(scored):
    assert [r[0] for r in rows(scoring.risk_histogram(scored.where(F.lit(False))), "count")] == [0] * 10
