"""Churn features by increments: what each month adds is stored once, so that a later cutoff reads later months only.

A store is a folder of Parquet tables. ``moments``, ``kinds`` and ``months`` are laid out by month of purchase: the sums
of each session's orders by moment, the payment types that a person used and when first, and the month's last order. A base
holds the same, summed by person, for all months before one of them. A cutoff needs a base no later than its own month and
the months from there on, which for a prediction window of 90 days are about four, however long the history is.

Orders without a time of purchase are left out, as they are in no window. Months that were stored before are replaced as a
whole, so a run that was lost can be repeated; a base does not notice, and is to be made again if it covers them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shopgauge.functions.columns import month_number
from shopgauge.operators import churn
from shopgauge.operators.facts import delivered
from shopgauge.schema import PERSON
from shopgauge.star import Star

_TS = "order_purchase_timestamp"


def month_of(moment: dt.datetime) -> int:
    """Months since year 0, as stored."""
    return moment.year * 12 + moment.month - 1


def add_months(star: Star, folder: str) -> None:
    """Store what the delivered orders of ``star`` add, in place of anything stored for the months that they are in.

    ``star`` holds whole months: all orders of a month, with their payments, reviews and customers.
    """
    people = star.customers.select("customer_id", PERSON, "customer_state").where(F.col(PERSON).isNotNull())
    month = month_number(_TS).cast("int").alias("month")
    orders = delivered(star).where(F.col(_TS).isNotNull())
    moments = (
        churn.orders_with_sums(star).where(F.col(_TS).isNotNull())
        .groupBy("customer_id", _TS)
        .agg(F.count("order_id").alias("orders"), *[F.sum(name).alias(name) for name in churn.ORDER_SUMS])
        .join(people, "customer_id").select("*", month)
    )
    used = star.order_payments.where(F.col("payment_type").isNotNull()).select("order_id", "payment_type").distinct()
    kinds = (
        used.join(orders.select("order_id", "customer_id", _TS), "order_id")
        .groupBy("customer_id", "payment_type", month).agg(F.min(_TS).alias("first_used"))
        .join(people, "customer_id")
        .groupBy(PERSON, "payment_type", "month").agg(F.min("first_used").alias("first_used"))
    )
    months = orders.groupBy(month).agg(F.max(_TS).alias("last_order"))
    for name, rows in {"moments": moments, "kinds": kinds, "months": months}.items():
        rows = rows.repartition("month", F.pmod(F.hash(rows.columns[0]), F.lit(32)))  # few files of each month
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{folder}/{name}")


def cutoff(spark: SparkSession, folder: str, window_days: int = churn.WINDOW_DAYS) -> dt.datetime:
    """End of the observation window of all that is stored, from one row a month."""
    schema = "last_order timestamp_ntz, month int"
    last = spark.read.schema(schema).parquet(f"{folder}/months").agg(F.max("last_order")).head()[0]
    if last is None:
        raise ValueError("no orders are stored")
    return last - dt.timedelta(days=window_days)


def _stored(spark: SparkSession, folder: str, since: int | None, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The moments and kinds of the months from ``since`` on and before ``before``; other months are not read."""
    moments = spark.read.parquet(f"{folder}/moments")
    kinds = spark.read.schema(
        T.StructType([moments.schema[PERSON], T.StructField("payment_type", T.StringType()),
                      T.StructField("first_used", moments.schema[_TS].dataType), T.StructField("month", T.IntegerType())])
    ).parquet(f"{folder}/kinds")
    wanted = (F.lit(True) if since is None else F.col("month") >= since) & (F.lit(True) if before is None else F.col("month") < before)
    return moments.where(wanted), kinds.where(wanted)


def _person_rows(moments: DataFrame) -> DataFrame:
    """Rows of persons that add up to their facts; the column ``seen`` tells the observation window."""

    def seen(name: str):
        return F.when(F.col("seen"), F.col(name))

    return moments.select(
        PERSON, seen("orders").alias("frequency"), seen(_TS).alias("last_obs_purchase"), seen(_TS).alias("first_purchase"),
        *[seen(name).alias(name) for name in churn.ORDER_SUMS], (~F.col("seen")).alias("came_back"),
    )


def _state_rows(moments: DataFrame) -> DataFrame:
    known = moments.where(F.col("seen") & F.col("customer_state").isNotNull())
    return known.select(PERSON, F.struct(_TS, "customer_id", "customer_state").alias("first"))


def _summed(persons: DataFrame) -> DataFrame:
    return persons.groupBy(PERSON).agg(
        F.sum("frequency").alias("frequency"), F.max("last_obs_purchase").alias("last_obs_purchase"),
        F.min("first_purchase").alias("first_purchase"), *[F.sum(name).alias(name) for name in churn.ORDER_SUMS],
        F.max("came_back").alias("came_back"),
    )


def _first_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy(PERSON).agg(F.min("first").alias("first"))


def _parts(spark: SparkSession, folder: str, base: int | None, seen, before: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of persons, states and payment types: those of the base, and those of the months from there on."""
    moments, kinds = _stored(spark, folder, base, before)
    moments = moments.withColumn("seen", seen(F.col(_TS)))
    parts = {
        "persons": _person_rows(moments), "states": _state_rows(moments),
        "kinds": kinds.where(seen(F.col("first_used"))).select(PERSON, "payment_type"),
    }
    if base is not None:
        parts = {name: rows.unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/base-{base}/{name}")) for name, rows in parts.items()}
    return parts["persons"], parts["states"], parts["kinds"].distinct()


def advance(spark: SparkSession, folder: str, month: int, base: int | None = None) -> int:
    """Write the base of all months before ``month``, from an earlier base and the months between; returns ``month``."""
    if base is not None and base >= month:
        raise ValueError(f"the base of month {base} is not before month {month}")
    persons, states, kinds = _parts(spark, folder, base, lambda ts: ts.isNotNull(), month)
    for name, rows in {"persons": _summed(persons), "states": _first_states(states), "kinds": kinds}.items():
        rows.write.mode("overwrite").parquet(f"{folder}/base-{month}/{name}")
    return month


def person_facts(spark: SparkSession, folder: str, end: dt.datetime, base: int | None = None) -> DataFrame:
    """What ``churn.person_facts`` gives, with payment types and states, for an observation window up to ``end``."""
    if base is not None and base > month_of(end):
        raise ValueError(f"the base of month {base} reaches beyond {end}")
    limit = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    persons, states, kinds = _parts(spark, folder, base, lambda ts: ts <= limit)
    types = kinds.groupBy(PERSON).agg(F.count(F.lit(1)).alias("type_count"))
    first = _first_states(states).select(PERSON, F.col("first.customer_state").alias("customer_state"))
    return (
        _summed(persons).where(F.col("frequency") > 0)
        .join(types, PERSON, "left").withColumn("type_count", F.coalesce("type_count", F.lit(0).cast("bigint")))
        .join(first, PERSON, "left")
    )


def churn_features(spark: SparkSession, folder: str, end: dt.datetime | None = None, base: int | None = None) -> DataFrame:
    """What ``churn.churn_features`` gives, out of a store; ``end`` is by default that of all that is stored."""
    complete, rate = churn.features_of(person_facts(spark, folder, end or cutoff(spark, folder), base))
    if rate is None:
        raise ValueError("no orders in the observation window: check the order dates")
    return complete
