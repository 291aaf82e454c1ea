"""Shared aggregates at the grain of an order, a session or a person.

Rows are summed to the join key before each join. A key that holds a large part of a table has then collapsed
on the map side before anything is shuffled by it, and no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.functions.columns import cents, month_number
from shopgauge.star import Star


def delivered(star: Star) -> DataFrame:
    return star.orders.where(F.col("order_status") == "delivered")


def payments_by_order(star: Star) -> DataFrame:
    return star.order_payments.groupBy("order_id").agg(
        F.sum(cents("payment_value")).alias("paid_cents"),
        F.count("payment_value").alias("paid_values"),
    )


def reviews_by_order(star: Star) -> DataFrame:
    score = F.col("review_score")
    return star.order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_rows"),
        F.count(score).alias("scores"),
        F.sum(score).alias("score_sum"),
        F.count_if(score >= 4).alias("positive"),
        F.count_if(score <= 2).alias("negative"),
    )


def paid_orders(star: Star) -> DataFrame:
    """Delivered orders that have payments, with their payment totals."""
    return (
        delivered(star)
        .select("order_id", "customer_id", "order_purchase_timestamp")
        .join(payments_by_order(star), "order_id")
    )


def sales_by_session(star: Star) -> DataFrame:
    return paid_orders(star).groupBy("customer_id").agg(
        F.count("order_id").alias("orders"),
        F.sum("paid_cents").alias("paid_cents"),
        F.sum("paid_values").alias("paid_values"),
        F.max("order_purchase_timestamp").alias("last_purchase"),
    )


def sales_by_person(star: Star) -> DataFrame:
    people = star.customers.select("customer_id", "customer_unique_id")
    return sales_by_session(star).join(people, "customer_id").groupBy("customer_unique_id").agg(
        F.sum("orders").alias("frequency"),
        F.sum("paid_cents").alias("monetary_cents"),
        F.max("last_purchase").alias("last_purchase"),
    )


def active_months(star: Star) -> DataFrame:
    """Each person's months with delivered orders, as (customer_unique_id, month) rows, each once.

    Orders collapse to the months of a session before they meet the customers, and these to the months of a person.
    """
    months = delivered(star).select("customer_id", month_number("order_purchase_timestamp").alias("month")).distinct()
    people = star.customers.select("customer_id", "customer_unique_id").where(F.col("customer_unique_id").isNotNull())
    return months.join(people, "customer_id").select("customer_unique_id", "month").distinct()


def with_category(rows: DataFrame, star: Star) -> DataFrame:
    """Rows with a product_id and their category: the English name where there is one, else the raw one.

    Two joins in a row rather than one with the joined dimensions: each side's own size then decides whether
    it is broadcast, where the size of a join would only be a product of guesses.
    """
    return (
        rows.join(star.products.select("product_id", "product_category_name"), "product_id")
        .join(
            star.category_translation.select("product_category_name", "product_category_name_english"),
            "product_category_name",
            "left",
        )
        .withColumn("category", F.coalesce("product_category_name_english", "product_category_name"))
        .drop("product_category_name", "product_category_name_english")
    )


def items_by_order_and_category(star: Star) -> DataFrame:
    items = star.order_items.select("order_id", "order_item_id", "product_id", "price")
    return (
        with_category(items, star)
        .groupBy("order_id", "category")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count("price").alias("prices"),
            F.sum(cents("price")).alias("price_cents"),
            F.sum("order_item_id").alias("item_numbers"),
        )
    )


def is_late(null_estimate_is_late: bool) -> Column:
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return F.coalesce(late, F.lit(True)) if null_estimate_is_late else late
