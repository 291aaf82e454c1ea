"""Values at ranks by nested histograms, against sorting."""

import random

import pytest
from builders import customer, order, payment, plan_of
from pyspark.sql import functions as F

from shopgauge.functions import selection
from shopgauge.operators import customers


def drawn(kind, count, seed):
    draw = random.Random(seed)
    return {
        "even": lambda: [draw.randint(-10**6, 10**6) for _ in range(count)],
        "hot": lambda: [draw.choice([5, 5, 5, 5, 9, draw.randint(0, 50)]) for _ in range(count)],
        "long tail": lambda: [int(10 ** draw.uniform(0, 15)) for _ in range(count)],
        "one value": lambda: [7] * count,
        "wide": lambda: [draw.choice([-(1 << 52), (1 << 52), draw.randint(0, 9)]) for _ in range(count)],
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "hot", "long tail", "one value", "wide"])
def test_ranks_of_keys_and_texts_equal_sorting(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "BUCKETS", 16)
    monkeypatch.setattr(selection, "FETCHED", 4)
    draw = random.Random(9)
    rows = [(key, "".join(draw.choice("abé0") for _ in range(draw.randint(0, 17))) + f"{i:05}") for i, key in enumerate(drawn(kind, 700, 3))]
    df = spark.createDataFrame(rows, "key long, name string").repartition(5)
    longest = max(len(name.encode()) for _, name in rows)
    orders = {"up": [F.col("key"), *selection.text_order("name", longest)], "down": [-F.col("key"), *selection.text_order("name", longest)]}
    ranks = {"up": [1, 2, 140, 350, 351, 699, 700], "down": [700, 1, 400]}
    got = selection.at_ranks(df, orders, ranks, F.col("name"))
    up = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    down = sorted(((-k, name) for k, name in rows), key=lambda r: (r[0], r[1].encode()))
    assert got["up"] == {r: up[r - 1] for r in ranks["up"]}
    assert got["down"] == {r: down[r - 1] for r in ranks["down"]}


def test_ranks_of_long_ids(spark, monkeypatch):
    monkeypatch.setattr(selection, "FETCHED", 3)
    draw = random.Random(1)
    ids = [draw.choice([draw.getrandbits(63), -draw.getrandbits(63), (1 << 53) + draw.randint(0, 40)]) for _ in range(500)]
    df = spark.createDataFrame([(1, i) for i in ids], "key long, id long")
    wanted = list(range(1, 501, 37))
    got = selection.at_ranks(df, {"o": [F.col("key"), *selection.long_order("id")]}, {"o": wanted}, F.col("id"))["o"]
    assert {r: v for r, (_, v) in got.items()} == {r: sorted(ids)[r - 1] for r in wanted}


def test_no_rows_and_equal_rows(spark):
    df = spark.createDataFrame([(4, "x")] * 2000, "key long, name string")
    assert selection.at_ranks(df, {"o": [F.col("key")]}, {"o": [1, 1000, 2000]}, F.col("name"))["o"] == {r: (4, "x") for r in (1, 1000, 2000)}
    assert selection.at_ranks(df.limit(0), {"o": [F.col("key")]}, {"o": []}, F.col("name")) == {"o": {}}


@pytest.fixture
def star(make_star):
    draw = random.Random(8)
    people = [f"p{i:03}" for i in range(300)]
    return make_star(
        customers=[customer(p) for p in people],
        orders=[order(f"o{p}", p, f"2024-{1 + i % 4:02}-{1 + i % 27:02}", delivered="2024-06-01") for i, p in enumerate(people)],
        order_payments=[payment(f"o{p}", round(draw.choice([20, draw.uniform(1, 900)]), 2)) for p in people],
    )


def test_plans_of_ranked_reports_exchange_no_persons(spark, star):
    for report in (customers.rfm_segments, customers.rfm_scores, customers.clv_distribution):
        plan = plan_of(report(star), "simple").replace("rangepartitioning(rfm_total", "")  # the result's own order
        assert "rangepartitioning" not in plan, report.__name__


def test_merged_sketches_are_the_sketch_of_all(spark, star):
    exact = customers.clv_distribution(star).first()
    sketches = customers.clv_sketches(star)
    assert sketches.count() == 4
    got = customers.clv_from_sketches(sketches).first()
    assert {k: v for k, v in got.asDict().items() if k != "median_clv"} == {k: v for k, v in exact.asDict().items() if k != "median_clv"}
    spend = sorted(r.monetary_cents / 100 for r in customers.sales_by_person(star).select("monetary_cents").collect())
    near = [spend[int((0.5 + d) * len(spend))] for d in (-0.01, 0.01)]
    assert near[0] <= got.median_clv <= near[1]
    halves = [customers.clv_from_sketches(sketches.where(F.month("cohort_month") % 2 == m)) for m in (0, 1)]
    assert sum(h.first().total_customers for h in halves) == exact.total_customers
