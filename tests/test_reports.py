"""Hand-computed cases of the definitions that are easy to get wrong."""

import datetime as dt

import pytest
from builders import customer, item, order, payment, review, rows

from shopgauge.operators import customers, sales, service


def test_average_is_per_payment_row_and_other_states_are_ignored(make_star):
    star = make_star(
        customers=[customer("c1"), customer("c2", state="S2")],
        orders=[order("o1", "c1", "2024-01-05"), order("o2", "c2", "2024-01-06", status="canceled")],
        order_payments=[payment("o1", 10.00), payment("o1", 5.01, sequence=2), payment("o2", 99)],
    )
    assert rows(sales.revenue_by_state(star), "state", "total_orders", "total_revenue", "avg_order_value") == [
        ("S1", 1, 15.01, 7.51)
    ]


def test_growth_is_null_first_and_over_zero(make_star):
    star = make_star(
        orders=[order("o1", "c", "2024-01-05"), order("o2", "c", "2024-02-05"), order("o3", "c", "2024-03-05"),
                order("o4", "c", "2024-04-05")],
        order_payments=[payment("o1", 100), payment("o2", 150), payment("o3", 0), payment("o4", 5)],
    )
    assert [r[0] for r in rows(sales.monthly_revenue_growth(star), "growth_pct")] == [None, 50.0, -100.0, None]


def test_kpis_of_an_empty_star_are_zero(make_star):
    row = sales.kpis(make_star()).first()
    assert tuple(row) == (0.0, 0, 0, 0.0, 0.0, 0.0)


def test_kpis(make_star):
    star = make_star(
        customers=[customer("c1", "p"), customer("c2", "p")],
        orders=[
            order("o1", "c1", "2024-01-01", delivered="2024-01-09", estimated="2024-01-08"),
            order("o2", "c2", "2024-01-02", delivered="2024-01-08", estimated="2024-01-08"),
            order("o3", "c2", "2024-01-03", delivered="2024-01-08"),
            order("o4", "c2", "2024-01-04", status="shipped"),
        ],
        order_payments=[payment("o1", 10), payment("o4", 7)],
        order_reviews=[review("r1", "o1", 5), review("r2", "o4", 2)],
    )
    assert tuple(sales.kpis(star).first()) == (10.0, 3, 1, 3.33, 3.5, 50.0)


def test_recent_orders_limit_comes_before_the_joins(make_star):
    star = make_star(
        customers=[customer("c1")],
        orders=[order(f"order_{i:02}_with_a_long_id", "c1", f"2024-01-{i:02} 10:00") for i in range(1, 26)]
        + [order("lonely", "nobody", "2024-02-01", status="shipped")],
        order_payments=[payment("order_25_with_a_long_id", 1, sequence=s) for s in (1, 2, 3)],
    )
    found = rows(sales.recent_orders(star), "order_id", "date", "state", "status", "value")
    assert len(found) == 22
    assert ("lonely...", "2024-02-01", None, "shipped", None) in found
    assert found.count(("order_25_wit...", "2024-01-25", "S1", "delivered", 1.0)) == 3


def test_category_report_keeps_null_and_counts_per_review(make_star):
    star = make_star(
        products=[("p1", "casa"), ("p2", None), ("p3", "moda")],
        category_translation=[("casa", "home")],
        order_items=[item("o1", 10), item("o1", 20, "p2", number=2), item("o2", 5, "p3", number=3)],
        order_reviews=[review("r1", "o1", 4), review("r2", "o1", 1)],
    )
    found = rows(
        service.category_performance(star), "category", "total_orders", "total_items_sold", "total_revenue",
        "avg_price", "avg_review_score",
    )
    assert found == [
        (None, 1, 4, 40.0, 20.0, 2.5), ("home", 1, 2, 20.0, 10.0, 2.5), ("moda", 1, 3, 5.0, 5.0, None),
    ]
    assert rows(sales.top_categories(star), "category", "revenue") == [("home", 10.0), ("moda", 5.0)]


def test_sentiment_needs_enough_pairs(make_star):
    star = make_star(
        products=[("p1", "casa"), ("p2", "moda")],
        order_items=[item("o1", 1), item("o1", 1, number=2), item("o2", 1, "p2")],
        order_reviews=[review("r1", "o1", 5), review("r2", "o1", None), review("r3", "o2", 1)],
    )
    got = rows(service.review_sentiment(star, at_least=2), "category", "total_reviews", "avg_score",
               "positive_reviews", "negative_reviews", "positive_rate_pct")
    assert got == [("casa", 2, 5.0, 2, 0, 100.0)]


def test_null_estimate_is_late_in_one_report_only(make_star):
    star = make_star(
        customers=[customer("c1")],
        orders=[
            order("o1", "c1", "2024-01-01 12:00", delivered="2024-01-03 00:00"),
            order("o2", "c1", "2024-01-01 00:00", delivered="2024-01-02 00:00", estimated="2024-01-02 00:00"),
            order("o3", "c1", "2024-01-01"),
        ],
    )
    assert rows(service.delivery_performance(star), "total_orders", "late_orders", "late_pct", "avg_delivery_days") == [
        (2, 1, 50.0, 1.3)
    ]
    assert sales.kpis(star).first().late_delivery_pct == 0.0


def test_seller_scorecard(make_star):
    orders = [order(f"o{i}", "c", "2024-01-01", delivered="2024-01-09", estimated="2024-01-08") for i in range(5)]
    orders[0] = order("o0", "c", "2024-01-01")
    star = make_star(
        orders=orders,
        order_items=[item(f"o{i}", 10) for i in range(5)] + [item("o1", 10, number=2)]
        + [item(f"o{i}", 1, seller="s2") for i in range(4)],
        order_reviews=[review("r1", "o1", 4), review("r2", "o1", 1)],
    )
    got = rows(service.seller_scorecard(star), "seller_id", "revenue", "orders", "avg_review", "late_rate")
    assert got == [("s1", 80.0, 5, 2.5, 1.0)]
    assert rows(service.seller_late_flag(star), "is_risky") == [(True,)]


def test_person_with_two_sessions_is_one_cohort_member(make_star):
    star = make_star(
        customers=[customer("c1", "p"), customer("c2", "p"), customer("c3", "q")],
        orders=[
            order("o1", "c1", "2023-12-31"), order("o2", "c2", "2024-01-01"), order("o3", "c2", "2024-03-09"),
            order("o4", "c1", "2024-02-09", status="canceled"), order("o5", "c3", "2024-01-15"),
        ],
    )
    d = dt.date
    assert rows(customers.cohort_retention_counts(star), "cohort_month", "month_offset", "active_customers") == [
        (d(2023, 12, 1), 0, 1), (d(2023, 12, 1), 1, 1), (d(2023, 12, 1), 3, 1), (d(2024, 1, 1), 0, 1),
    ]
    assert rows(customers.monthly_retention(star), "active_count", "retained_count", "retention_rate_pct") == [
        (1, 1, 100.0), (2, 0, 0.0), (1, 0, 0.0),
    ]
    assert tuple(customers.repeat_purchase_rate(star).first()) == (2, 1, 50.0)
    assert rows(customers.cohort_matrix(star), "cohort_month", "m0", "m1", "m2", "m3") == [
        ("2023-12", 100, 100, None, 100), ("2024-01", 100, None, None, None),
    ]
    assert rows(customers.month_dropoff(star), "inactive_pct") == [(100.0,), (100.0,)]


def people_star(make_star, n, spend=lambda i: i, day=lambda i: i % 28 + 1):
    return make_star(
        customers=[customer(f"c{i:02}") for i in range(n)],
        orders=[order(f"o{i:02}", f"c{i:02}", f"2024-01-{day(i):02}") for i in range(n)],
        order_payments=[payment(f"o{i:02}", spend(i)) for i in range(n)],
    )


def test_tiles_and_quantile_bins_differ(make_star):
    star = people_star(make_star, 7)
    tiles = dict(rows(customers.rfm_segments(star), "customer_unique_id", "m_score"))
    assert [tiles[f"c{i:02}"] for i in range(7)] == [1, 1, 2, 2, 3, 4, 5]
    bins = dict(rows(customers.rfm_scores(star), "customer_unique_id", "m_score"))
    assert [bins[f"c{i:02}"] for i in range(7)] == [1, 1, 2, 3, 4, 5, 5]


def test_recency_runs_opposite_ways(make_star):
    star = people_star(make_star, 10)
    latest = "c09"
    assert dict(rows(customers.rfm_segments(star), "customer_unique_id", "r_score"))[latest] == 1
    assert dict(rows(customers.rfm_scores(star), "customer_unique_id", "r_score"))[latest] == 5


def test_equal_recency_is_refused_only_when_strict(make_star):
    star = people_star(make_star, 6, day=lambda i: 3)
    assert {r[0] for r in rows(customers.rfm_scores(star), "r_score")} == {5}
    with pytest.raises(ValueError, match="not unique"):
        customers.rfm_scores(star, strict=True)


def test_rfm_of_one_person_and_of_nobody(make_star):
    assert rows(customers.rfm_segment_counts(people_star(make_star, 1)), "count") == [(1,)]
    assert rows(customers.rfm_segments(make_star()), "segment") == []
    assert rows(customers.rfm_scores(make_star()), "r_score") == []


def test_clv_median_of_even_and_odd(make_star):
    even = customers.clv_distribution(people_star(make_star, 4, spend=lambda i: [1.00, 2.00, 2.01, 9.00][i])).first()
    assert (even.total_customers, even.median_clv, even.avg_clv, even.min_clv, even.max_clv) == (4, 2.01, 3.5, 1.0, 9.0)
    odd = customers.clv_distribution(people_star(make_star, 3, spend=lambda i: [1, 5, 6][i])).first()
    assert (odd.median_clv, odd.stddev_clv) == (5.0, 2.65)


def test_pareto_rounds_the_number_of_sellers_up(make_star):
    star = make_star(order_items=[item(f"o{i}", 10 * (i + 1), seller=f"s{i}") for i in range(6)])
    assert tuple(service.seller_pareto(star).first()) == (6, 2, 110.0, 210.0, 52.38)


def test_late_orders_review_worse(make_star):
    star = make_star(
        orders=[order("o1", "c", "2024-01-01", delivered="2024-01-09", estimated="2024-01-08"),
                order("o2", "c", "2024-01-01", delivered="2024-01-07", estimated="2024-01-08")],
        order_reviews=[review("r1", "o1", 2), review("r2", "o2", 5), review("r3", "o2", 4)],
    )
    assert tuple(service.late_vs_review(star).first()) == (4.5, 2.0, 2.5)


def test_a_date_far_off_makes_no_wider_plan(make_star):
    star = make_star(
        customers=[customer("c1", "u1"), customer("c2", "u1")],
        orders=[order("o1", "c1", "1995-12-05"), order("o2", "c2", "9999-12-31"), order("o3", "c1", "1996-01-01")],
    )
    got = rows(customers.monthly_retention(star), "active_month", "active_count", "retained_count")
    assert got == [(dt.date(1995, 12, 1), 1, 1), (dt.date(1996, 1, 1), 1, 0), (dt.date(9999, 12, 1), 1, 0)]
    assert [r.month_offset for r in customers.cohort_retention_counts(star).collect()] == [0, 1, 12 * 8004]


def test_statements_answer_as_the_operators_do_and_take_parameters(spark, make_star):
    from shopgauge.operators import statements

    people = [f"p{i:02}" for i in range(40)]
    star = make_star(
        customers=[customer(f"{p}{k}", p, f"S{i % 3}") for i, p in enumerate(people) for k in "ab"],
        orders=[order(f"o{p}{k}", f"{p}{k}", f"2024-{1 + (i + n) % 5:02}-{1 + i % 27:02} 10:30:00", delivered=f"2024-07-{1 + i % 27:02} 09:00:00" if i % 9 else None,
                      estimated="2024-07-12" if i % 5 else None, status="delivered" if i % 7 else "shipped")
                for i, p in enumerate(people) for n, k in enumerate("ab")],
        order_payments=[payment(f"o{p}{k}", 10 + i % 13 + 0.05, ["boleto", "voucher"][i % 2], 1 + i % 4, n + 1)
                        for i, p in enumerate(people) for n, k in enumerate("aab") if i % 11],
        order_items=[item(f"o{p}{k}", 5 + i % 17, f"q{i % 4}", f"s{i % 6}", n + 1) for i, p in enumerate(people) for n, k in enumerate("aba")],
        order_reviews=[review(f"r{p}{n}", f"o{p}a", 1 + (i + n) % 5 if i % 8 else None) for i, p in enumerate(people) for n in range(i % 4)],
        products=[(f"q{i}", f"c{i % 3}") for i in range(4)], category_translation=[("c1", "one")], sellers=[(f"s{i}", "0", "city", "S1") for i in range(5)],
    )

    operators = {name: getattr(module, name) for module in (sales, customers, service) for name in statements.STATEMENTS if hasattr(module, name)}
    assert set(operators) == set(statements.STATEMENTS)
    for name, operator in operators.items():
        want, got = operator(star), statements.run(spark, star, name)
        assert got.columns == want.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert statements.run(spark, star, "top_sellers", top=1).count() == min(1, service_sellers(star))
    assert statements.run(spark, star, "repeat_purchase_rate", status="nowhere").first().total_customers == 0


def service_sellers(star):
    return star.order_items.select("seller_id").distinct().count()


def test_statements_of_an_empty_star(spark, make_star):
    from shopgauge.operators import statements

    empty = make_star()
    for name in statements.STATEMENTS:
        rows_found = statements.run(spark, empty, name).collect()
        assert len(rows_found) in (0, 1) and (not rows_found or rows_found[0].total_customers == 0), name
