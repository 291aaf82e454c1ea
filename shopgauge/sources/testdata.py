"""The order star, A/B units and trial histories as views over the TPC-H-like test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopgauge.star import Star

Reader = Callable[[str], DataFrame]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


# Column types of the test tables.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table with declared types, so that building a plan opens no file."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _customers(read: Reader) -> DataFrame:
    key = F.col("c_custkey")
    folded = F.pmod(key, F.lit(10)).isin(8, 9)
    return (
        read("customer")
        .join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("customer_id"),
            F.when(folded, key - F.pmod(key, F.lit(10))).otherwise(key).alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        )
    )


def _orders(read: Reader) -> DataFrame:
    order = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")

    def after(days: Column) -> Column:
        return F.date_add(day, days.cast("int")).cast("timestamp_ntz")

    return read("orders").select(
        order.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        # nested and null-safe, so that a filter on one status folds to a filter on the file's column
        F.when(status.eqNullSafe("F"), "delivered")
        .otherwise(F.when(status.eqNullSafe("O"), "shipped").otherwise("processing"))
        .alias("order_status"),
        day.cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.when(status.isin("F", "O") & (order % 50 != 7), after(5 + order % 23 + (order * 7) % 13 - 6))
        .alias("order_delivered_customer_date"),
        after(7 + order % 23).alias("order_estimated_delivery_date"),
    )


def _payments(read: Reader) -> DataFrame:
    order = F.col("o_orderkey")
    on_card = F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    return read("orders").select(
        order.alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.when(on_card, "credit_card")
        .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "voucher")
        .otherwise("debit_card")
        .alias("payment_type"),
        F.when(on_card, 1 + order % 12).otherwise(F.lit(1)).alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
    )


def _items(read: Reader) -> DataFrame:
    return read("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )


def _products(read: Reader) -> DataFrame:
    return read("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"))


def _category_translation(read: Reader) -> DataFrame:
    """Four of the six categories, so that both branches of the fallback occur."""
    kind = F.col("p_type")
    return (
        read("part")
        .where(kind.isin("MEDIUM", "STANDARD", "LARGE", "PROMO"))
        .select(
            kind.alias("product_category_name"),
            F.concat(F.lower(kind), F.lit("_goods")).alias("product_category_name_english"),
        )
        .distinct()
    )


def _sellers(read: Reader) -> DataFrame:
    return (
        read("supplier")
        .join(read("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )


def _reviews(read: Reader) -> DataFrame:
    """One review of most delivered orders, and a second one of a few."""
    order = F.col("o_orderkey")
    roll = (order * 37) % 100
    score = F.when(roll < 11, 1).when(roll < 17, 2).when(roll < 26, 3).when(roll < 46, 4).otherwise(5)
    both = F.array(
        F.when(order % 10 != 0, F.struct(order.alias("review_id"), score.alias("review_score"))),
        F.when(order % 97 == 1, F.struct((-order).alias("review_id"), F.lit(1).alias("review_score"))),
    )
    return (
        read("orders")
        .where(F.col("o_orderstatus") == "F")
        .select(order.alias("order_id"), F.inline(F.array_compact(both)))
        .select("review_id", "order_id", "review_score")
    )


def star(spark: SparkSession, sf_dir: str) -> Star:
    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    makers = {
        "customers": _customers, "orders": _orders, "sellers": _sellers, "products": _products,
        "category_translation": _category_translation, "order_items": _items, "order_payments": _payments,
        "order_reviews": _reviews,
    }
    return Star(**{name: partial(make, read) for name, make in makers.items()})


def _arm(user: Column) -> Column:
    return F.when(user % 2 == 0, "control").otherwise("treatment").alias("arm")


def rate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per user and day, one experiment per event type: did such an event happen that day?"""
    flags = [
        F.max((F.col("event_type") == kind).cast("int")).cast("double").alias(f"{kind}_rate") for kind in EVENT_TYPES
    ]
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("dt")).agg(*flags)
    return days.unpivot(
        ["user_id", "dt"], [f"{kind}_rate" for kind in EVENT_TYPES], "experiment", "outcome"
    ).select(
        "experiment",
        F.concat(F.lit("days with "), F.regexp_replace("experiment", "_rate$", "")).alias("metric"),
        F.concat_ws("@", "user_id", "dt").alias("unit_id"),
        _arm(F.col("user_id")),
        "outcome",
    )


def value_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per event, one experiment per event type: the value of the event."""
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("_value")).alias("experiment"),
        F.concat(F.lit("value of "), "event_type").alias("metric"),
        F.col("event_id").cast("string").alias("unit_id"),
        _arm(F.col("user_id")),
        F.col("value").alias("outcome"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial histories: one study per user, one trial per event; an error event is a failed trial."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("study"),
        F.col("event_id").alias("number"),
        F.when(~failed, F.col("value") / 1000).alias("value"),
        F.struct(
            (50 + F.col("event_id") % 251).alias("n_estimators"),
            (3 + F.col("event_id") % 8).alias("max_depth"),
            ((1 + F.col("event_id") % 30) / 100.0).alias("learning_rate"),
        ).alias("params"),
        F.when(failed, "FAIL").otherwise("COMPLETE").alias("state"),
    )


def request_rows(features: DataFrame) -> DataFrame:
    """Scoring requests from feature rows: some fields left out, some out of range, by the digits of the id."""
    uid = F.col("customer_unique_id")
    faults = {
        "frequency": [(uid % 13 == 1, F.lit(None)), (uid % 17 == 2, F.lit(0))],
        "monetary": [(uid % 19 == 3, F.lit(-1.0))],
        "avg_installments": [(uid % 23 == 4, F.lit(0.5))],
        "avg_review_score": [(uid % 7 == 5, F.lit(None)), (uid % 29 == 6, F.lit(5.5))],
        "review_count": [(uid % 11 == 7, F.lit(None))],
        "avg_days_between_orders": [(uid % 5 == 0, F.lit(None))],
        "state_encoded": [(uid % 31 == 8, F.lit(-1))],
    }
    def spoiled(name: str) -> Column:
        kind = features.schema[name].dataType
        return reduce(
            lambda inner, fault: F.when(fault[0], fault[1].cast(kind)).otherwise(inner),
            reversed(faults.get(name, [])),
            F.col(name),
        ).alias(name)

    return features.select(*[spoiled(name) for name in features.columns if name != "is_churned"])
