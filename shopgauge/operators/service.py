"""Delivery, reviews and sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.functions.columns import (
    array_round, cents, elapsed_fraction, elapsed_seconds, half_up, mean_money, money, percent, safe_ratio, wide,
)
from shopgauge.functions.selection import at_ranks, id_order
from shopgauge.operators.facts import delivered, is_late, items_by_order_and_category, reviews_by_order
from shopgauge.session import materialize
from shopgauge.star import Star

_MICROS_PER_TENTH_DAY = 8640000000


def category_performance(star: Star, top: int = 15) -> DataFrame:
    """Orders, sold-item numbers, price and review averages by category.

    The report counts an item once per review of its order (once if there is none) and adds up item numbers.
    Here each (order, category) row carries that multiplicity instead of being repeated.
    """
    facts = items_by_order_and_category(star).join(reviews_by_order(star), "order_id", "left")
    times = F.coalesce("review_rows", F.lit(1))
    return (
        facts.groupBy("category")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum(F.col("item_numbers") * times).alias("total_items_sold"),
            F.sum(F.col("price_cents") * times).alias("price_cents"),
            F.sum(F.col("prices") * times).alias("prices"),
            F.sum(F.col("items") * F.col("score_sum")).alias("score_sum"),
            F.sum(F.col("items") * F.col("scores")).alias("scores"),
        )
        .orderBy(F.desc("price_cents"), "category")
        .limit(top)
        .select(
            "category", "total_orders", "total_items_sold",
            money("price_cents").alias("total_revenue"),
            mean_money("price_cents", "prices").alias("avg_price"),
            mean_money(F.col("score_sum") * 100, "scores").alias("avg_review_score"),
        )
    )


def review_sentiment(star: Star, at_least: int = 50) -> DataFrame:
    """Scores by category over (review, item) pairs, for categories with enough of them."""
    facts = items_by_order_and_category(star).join(reviews_by_order(star), "order_id")

    def pairs(name: str) -> Column:
        return F.sum(F.col("items") * F.col(name)).alias(name)

    return (
        facts.groupBy("category")
        .agg(pairs("scores"), pairs("score_sum"), pairs("positive"), pairs("negative"))
        .where(F.col("scores") >= at_least)
        .select(
            "category",
            F.col("scores").alias("total_reviews"),
            mean_money(F.col("score_sum") * 100, "scores").alias("avg_score"),
            F.col("positive").alias("positive_reviews"),
            F.col("negative").alias("negative_reviews"),
            percent("positive", "scores").alias("positive_rate_pct"),
        )
        .orderBy(F.desc("avg_score"), "category")
    )


def delivery_performance(star: Star) -> DataFrame:
    """Late share and mean delivery time by state; an order without an estimate counts as late."""
    span = ("order_delivered_customer_date", "order_purchase_timestamp")
    sessions = (
        delivered(star)
        .where(F.col("order_delivered_customer_date").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(is_late(null_estimate_is_late=True)).alias("late"),
            F.sum(elapsed_seconds(*span)).alias("seconds"),
            F.sum(elapsed_fraction(*span)).alias("fraction"),
        )
    )
    return (
        sessions.join(star.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("late").alias("late_orders"),
            F.sum("seconds").alias("seconds"),
            F.sum("fraction").alias("fraction"),
        )
        .withColumn("micros", wide("seconds") * 1000000 + F.col("fraction"))
        .select(
            "customer_state", "total_orders", "late_orders",
            percent("late_orders", "total_orders").alias("late_pct"),
            (half_up("micros", wide("total_orders") * _MICROS_PER_TENTH_DAY).cast("double") / 10.0)
            .alias("avg_delivery_days"),
        )
        .orderBy(F.desc("late_pct"), "customer_state")
    )


def _items_by_order_and_seller(star: Star) -> DataFrame:
    return star.order_items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(cents("price")).alias("price_cents")
    )


def seller_scorecard(star: Star, min_orders: int = 5, top: int = 50) -> DataFrame:
    """Revenue, orders, mean review and late rate per seller of delivered orders, first sellers by id.

    Revenue and reviews count an item once per review of its order; the late rate counts items once, over
    orders with both dates. Missing values are 0.
    """
    late = is_late(null_estimate_is_late=False)
    orders = delivered(star).select("order_id", late.alias("late"))
    facts = (
        _items_by_order_and_seller(star)
        .join(orders, "order_id")
        .join(reviews_by_order(star), "order_id", "left")
    )
    per_seller = (
        facts.where(F.col("seller_id").isNotNull())
        .groupBy("seller_id")
        .agg(
            F.sum(F.col("price_cents") * F.coalesce("review_rows", F.lit(1))).alias("price_cents"),
            F.count("order_id").alias("orders"),
            F.sum(F.col("items") * F.col("score_sum")).alias("score_sum"),
            F.sum(F.col("items") * F.col("scores")).alias("scores"),
            F.sum(F.when(F.col("late"), F.col("items")).when(~F.col("late"), F.lit(0))).alias("late_items"),
            F.sum(F.when(F.col("late").isNotNull(), F.col("items"))).alias("dated_items"),
        )
        .where(F.col("orders") >= min_orders)
    )
    return (
        per_seller.orderBy("seller_id")
        .limit(top)
        .select(
            "seller_id",
            money(F.coalesce("price_cents", F.lit(0))).alias("revenue"),
            "orders",
            F.coalesce(array_round(safe_ratio(F.col("score_sum"), F.col("scores")), 2), F.lit(0.0)).alias("avg_review"),
            F.coalesce(array_round(safe_ratio(F.col("late_items"), F.col("dated_items")), 3), F.lit(0.0))
            .alias("late_rate"),
        )
    )


def seller_late_flag(star: Star, above: float = 0.3) -> DataFrame:
    return seller_scorecard(star).select("seller_id", "late_rate", (F.col("late_rate") > above).alias("is_risky"))


def late_vs_review(star: Star) -> DataFrame:
    """Mean review score of on-time and late delivered orders, and the gap."""
    orders = delivered(star).select("order_id", is_late(null_estimate_is_late=False).alias("late"))
    facts = orders.where(F.col("late").isNotNull()).join(reviews_by_order(star), "order_id")

    def mean(when: Column) -> Column:
        return safe_ratio(F.sum(F.when(when, F.col("score_sum"))), F.sum(F.when(when, F.col("scores"))))

    return facts.agg(mean(~F.col("late")).alias("on_time"), mean(F.col("late")).alias("late")).select(
        F.round("on_time", 4).alias("on_time_score"),
        F.round("late", 4).alias("late_score"),
        F.round(F.col("on_time") - F.col("late"), 4).alias("gap"),
    )


def seller_pareto(star: Star, top_pct: int = 20) -> DataFrame:
    """Revenue share of the top sellers (the first ``top_pct`` percent of all that sold anything)."""
    sold = star.order_items.groupBy("seller_id").agg(F.sum(cents("price")).alias("price_cents"))
    revenue = materialize(sold, "seller-revenue")
    n = revenue.count()
    last = -(-n * top_pct // 100)
    key = F.coalesce(-F.col("price_cents"), F.lit(1 << 60))
    is_top = F.lit(False)
    if last:
        # A null id comes first among equals.
        order = [key, F.col("seller_id").isNotNull().cast("int"), *[F.coalesce(d, F.lit(0)) for d in id_order(revenue, "seller_id")]]
        cut_key, cut_seller = at_ranks(revenue, {"cut": order}, {"cut": [last]}, F.col("seller_id"))["cut"][last]
        upto = F.col("seller_id").isNull() | F.coalesce(F.col("seller_id") <= F.lit(cut_seller), F.lit(False))
        is_top = (key < cut_key) | ((key == cut_key) & upto)
    return revenue.agg(
        F.count(F.lit(1)).alias("sellers"),
        F.count_if(is_top).alias("top_sellers"),
        F.sum(F.when(is_top, F.col("price_cents"))).alias("top_cents"),
        F.sum("price_cents").alias("all_cents"),
    ).select(
        "sellers", "top_sellers",
        money("top_cents").alias("top_revenue"),
        money("all_cents").alias("total_revenue"),
        percent("top_cents", "all_cents").alias("top_share_pct"),
    )
