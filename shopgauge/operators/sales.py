"""Revenue by state, month, category, seller and payment type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shopgauge.functions.columns import (
    array_round, cents, half_up, mean_money, money, month, month_label, percent, safe_ratio,
)
from shopgauge.operators.facts import (
    delivered, is_late, paid_orders, payments_by_order, sales_by_session, with_category,
)
from shopgauge.star import Star


def _sales_by_state(star: Star) -> DataFrame:
    states = star.customers.select("customer_id", F.col("customer_state").alias("state"))
    return sales_by_session(star).join(states, "customer_id").groupBy("state").agg(
        F.sum("orders").alias("total_orders"),
        F.sum("paid_cents").alias("paid_cents"),
        F.sum("paid_values").alias("paid_values"),
    )


def revenue_by_state(star: Star, top: int = 10) -> DataFrame:
    """The states with most delivered revenue; the average is over payment rows, not orders."""
    return (
        _sales_by_state(star)
        .orderBy(F.desc("paid_cents"), "state")
        .limit(top)
        .select(
            "state", "total_orders", money("paid_cents").alias("total_revenue"),
            mean_money("paid_cents", "paid_values").alias("avg_order_value"),
        )
    )


def top_states(star: Star, top: int = 10) -> DataFrame:
    return (
        _sales_by_state(star)
        .where(F.col("state").isNotNull())
        .orderBy(F.desc("paid_cents"), "state")
        .limit(top)
        .select("state", money("paid_cents").alias("revenue"))
    )


def state_revenue_share(star: Star) -> DataFrame:
    """Each state's share of delivered revenue."""
    everything = F.sum("paid_cents").over(Window.partitionBy())
    return _sales_by_state(star).select(
        "state", money("paid_cents").alias("revenue"), percent("paid_cents", everything).alias("share_pct")
    )


def _revenue_by_month(star: Star) -> DataFrame:
    return paid_orders(star).groupBy(month("order_purchase_timestamp").alias("month")).agg(
        F.sum("paid_cents").alias("paid_cents"), F.count("order_id").alias("orders")
    )


def monthly_revenue_growth(star: Star) -> DataFrame:
    previous = F.lag("paid_cents").over(Window.orderBy("month"))
    return (
        _revenue_by_month(star)
        .withColumn("previous", previous)
        .select(
            "month",
            money("paid_cents").alias("revenue"),
            money("previous").alias("prev_month_revenue"),
            percent(F.col("paid_cents") - F.col("previous"), "previous").alias("growth_pct"),
        )
        .orderBy("month")
    )


def revenue_trend(star: Star) -> DataFrame:
    return (
        _revenue_by_month(star)
        .select(month_label("month").alias("month"), money("paid_cents").alias("revenue"), "orders")
        .orderBy("month")
    )


def cumulative_revenue(star: Star) -> DataFrame:
    """Month revenue and its running total; months number a few hundred at most."""
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _revenue_by_month(star)
        .select(
            month_label("month").alias("month"),
            money("paid_cents").alias("payment_value"),
            money(F.sum("paid_cents").over(so_far)).alias("cumulative"),
        )
        .orderBy("month")
    )


def top_sellers(star: Star, top: int = 10) -> DataFrame:
    """Sellers by item revenue over orders of any status."""
    per_seller = (
        star.order_items.groupBy("seller_id", "order_id")
        .agg(F.sum(cents("price")).alias("price_cents"), F.count("price").alias("prices"))
        .groupBy("seller_id")
        .agg(
            F.count("order_id").alias("orders_fulfilled"),
            F.sum("price_cents").alias("price_cents"),
            F.sum("prices").alias("prices"),
        )
    )
    return (
        per_seller.join(star.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
        .orderBy(F.desc("price_cents"), "seller_id")
        .limit(top)
        .select(
            "seller_id", "seller_city", "seller_state", "orders_fulfilled",
            money("price_cents").alias("total_revenue"),
            mean_money("price_cents", "prices").alias("avg_item_price"),
        )
    )


def top_categories(star: Star, top: int = 10) -> DataFrame:
    """Categories by item revenue over orders of any status; items without a category are left out."""
    per_product = star.order_items.groupBy("product_id").agg(F.sum(cents("price")).alias("price_cents"))
    return (
        with_category(per_product, star)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("price_cents").alias("price_cents"))
        .orderBy(F.desc("price_cents"), "category")
        .limit(top)
        .select("category", money("price_cents").alias("revenue"))
    )


def payment_mix(star: Star) -> DataFrame:
    """Delivered payment value by payment type."""
    paid = star.order_payments.groupBy("order_id", "payment_type").agg(F.sum(cents("payment_value")).alias("cents"))
    return (
        paid.join(delivered(star).select("order_id"), "order_id")
        .where(F.col("payment_type").isNotNull())
        .groupBy(F.col("payment_type").alias("type"))
        .agg(money(F.sum("cents")).alias("value"))
        .orderBy("type")
    )


def payment_method_analysis(star: Star) -> DataFrame:
    """Count, value and instalments by payment type over all payments, ranked by value."""
    return (
        star.order_payments.groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum(cents("payment_value")).alias("cents"),
            F.count("payment_value").alias("values"),
            F.sum(F.col("payment_installments").cast("bigint")).alias("installments"),
            F.count("payment_installments").alias("installment_values"),
        )
        .select(
            "payment_type",
            "transaction_count",
            money("cents").alias("total_value"),
            mean_money("cents", "values").alias("avg_value"),
            (half_up(F.col("installments") * 10, "installment_values").cast("double") / 10.0).alias("avg_installments"),
            F.rank().over(Window.orderBy(F.desc("cents"))).cast("bigint").alias("revenue_rank"),
        )
        .orderBy(F.desc("total_value"))
    )


def payment_type_share(star: Star) -> DataFrame:
    """Share of payments made by each type."""
    per_type = star.order_payments.groupBy("payment_type").agg(F.count(F.lit(1)).alias("payments"))
    everything = F.sum("payments").over(Window.partitionBy())
    return per_type.select("payment_type", "payments", percent("payments", everything).alias("share_pct"))


def kpis(star: Star) -> DataFrame:
    """One row of headline numbers.

    Each part is an aggregate of its own; the one-row results are stacked and folded into one row.
    """
    orders = delivered(star)
    dated = F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull()
    revenue = paid_orders(star).agg(F.sum("paid_cents").alias("paid_cents"))
    order_counts = orders.agg(
        F.count("order_id").alias("total_orders"),
        F.count_if(dated).alias("dated"),
        F.count_if(is_late(null_estimate_is_late=False)).alias("late"),
    )
    people = (
        orders.select("customer_id").distinct()
        .join(star.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .agg(F.count_distinct("customer_unique_id").alias("unique_customers"))
    )
    reviews = star.order_reviews.agg(F.sum("review_score").alias("score_sum"), F.count("review_score").alias("scores"))

    stacked = revenue
    for part in (order_counts, people, reviews):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = stacked.columns
    row = stacked.agg(*[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in names])

    def or_zero(value):
        return F.coalesce(value, F.lit(0.0))

    return row.select(
        money("paid_cents").alias("total_revenue"),
        "total_orders",
        "unique_customers",
        or_zero(array_round(safe_ratio(money("paid_cents"), F.col("total_orders")), 2)).alias("avg_order_value"),
        or_zero(array_round(safe_ratio(F.col("score_sum"), F.col("scores")), 2)).alias("avg_review_score"),
        or_zero(array_round(safe_ratio(F.col("late"), F.col("dated")) * 100, 1)).alias("late_delivery_pct"),
    )


def recent_orders(star: Star, top: int = 20) -> DataFrame:
    """The latest orders with state and payments; the limit comes before the joins, so rows can exceed it.

    The few orders are fetched first, in one scan; their ids then filter the scans of the other tables.
    """
    orders = star.orders.select("order_id", "customer_id", "order_purchase_timestamp", "order_status")
    found = orders.orderBy(F.desc("order_purchase_timestamp"), "order_id").limit(top).collect()
    latest = orders.sparkSession.createDataFrame(found, orders.schema)

    def of_latest(table: DataFrame, key: str) -> DataFrame:
        return table.where(F.col(key).isin([row[key] for row in found]))

    customers = of_latest(star.customers.select("customer_id", "customer_state"), "customer_id")
    payments = of_latest(star.order_payments.select("order_id", "payment_value"), "order_id")
    return (
        latest.join(customers, "customer_id", "left")
        .join(payments, "order_id", "left")
        .select(
            F.concat(F.substring(F.col("order_id").cast("string"), 1, 12), F.lit("...")).alias("order_id"),
            F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("date"),
            F.col("customer_state").alias("state"),
            F.col("order_status").alias("status"),
            money(cents("payment_value")).alias("value"),
        )
    )


def dataset_summary(star: Star, focus_state: str) -> DataFrame:
    """Row counts, delivered revenue, distinct states and the share of customers in one state."""
    paid = payments_by_order(star).join(delivered(star).select("order_id"), "order_id", "left_semi")
    customers = star.customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("customer_state").alias("unique_states"),
        F.count_if(F.col("customer_state") == focus_state).alias("in_focus"),
    )
    stacked = paid.agg(F.sum("paid_cents").alias("paid_cents"))
    for part in (
        customers,
        star.orders.agg(F.count(F.lit(1)).alias("orders")),
        star.sellers.agg(F.count(F.lit(1)).alias("sellers")),
    ):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
    return row.select(
        "customers", "orders", "sellers", money(F.coalesce("paid_cents", F.lit(0))).alias("delivered_revenue"),
        "unique_states",
        array_round(safe_ratio(F.col("in_focus"), F.col("customers")) * 100, 1).alias("focus_share_pct"),
    )
