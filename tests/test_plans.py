"""What the physical plans must and must not contain."""

import re

from builders import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shopgauge.operators import churn, facts, sales
from shopgauge.sources import testdata
from shopgauge.sources.tables import save_as_bucketed_table
from shopgauge.star import Star

SF_DIR = "/root/testdata/sf0.001"
def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(contract.queries()["revenue_trend"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*o_orderstatus,F", plan)
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert all("o_orderpriority" not in s for s in schemas)
    assert any("o_totalprice" in s and "o_custkey" not in s for s in schemas)


def test_cutoff_reaches_the_scan_of_declared_timestamps(spark, tmp_path):
    star = testdata.star(spark, SF_DIR)
    star.orders.write.parquet(str(tmp_path / "orders"))
    tables = {**star.tables(), "orders": spark.read.parquet(str(tmp_path / "orders"))}
    later = facts.delivered(Star(**tables)).where(F.col("order_purchase_timestamp") > churn.cutoff(Star(**tables)))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(order_purchase_timestamp,ScalarSubquery", plan_of(later))


def test_top_k_needs_no_full_sort(spark):
    for name in ("revenue_by_state", "top_sellers", "top_categories", "seller_scorecard", "high_risk_top20"):
        assert "TakeOrderedAndProject" in plan_of(contract.queries()[name](spark, SF_DIR)), name


def test_unused_joins_are_pruned(spark):
    plan = plan_of(contract.queries()["review_features"](spark, SF_DIR))
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
    label = plan_of(contract.queries()["churn_label"](spark, SF_DIR))
    assert "review_score" not in label and "o_totalprice" not in label


def test_features_hash_their_sums_and_collect_no_sets(spark):
    star = testdata.star(spark, SF_DIR)
    for facts_of in (churn.person_facts(star, payment_types=True), churn.first_states(star), churn.order_features(star)):
        plan = plan_of(facts_of, "simple")
        assert "SortAggregate" not in plan and "collect_set" not in plan


def test_hot_key_of_a_dimension_join_is_split_at_run_time(spark):
    """Items of one product fill a third of the table; the join with products splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.files.maxPartitionBytes": "256KB",
    }
    star = testdata.star(spark, "/root/testdata/sf0.01")
    hot = star.order_items.withColumn(
        "product_id", F.when(F.col("order_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("product_id"))
    )
    tables = {**star.tables(), "order_items": hot.repartition(16)}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = facts.items_by_order_and_category(Star(**tables))
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_bucketed_star_sums_and_joins_orders_without_a_shuffle(spark, tmp_path):
    star = testdata.star(spark, SF_DIR)
    spark.sql(f"create database if not exists bucketed location '{tmp_path / 'bucketed.db'}'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = {}
        for name in ("orders", "order_payments"):
            save_as_bucketed_table(getattr(star, name), name, 4, database="bucketed")
            stored[name] = spark.table(f"bucketed.{name}")
        assert "Exchange" not in plan_of(facts.paid_orders(Star(**{**star.tables(), **stored})))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database bucketed cascade")


def test_hot_order_collapses_before_the_shuffle(spark):
    """Payments are summed on the map side: the exchange sits above a partial aggregate."""
    plan = plan_of(facts.payments_by_order(testdata.star(spark, SF_DIR)), "simple")
    assert re.search(r"Exchange hashpartitioning\(order_id.*\n.*HashAggregate.*partial_sum", plan)
    assert "SortAggregate" not in plan_of(sales.revenue_by_state(testdata.star(spark, SF_DIR)))
