"""Churn features and labels from a temporal split, and checks of scoring requests."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from shopgauge.functions.columns import cents, money, safe_ratio, whole_days
from shopgauge.operators.facts import delivered
from shopgauge.schema import FEATURES, LABEL, PERSON
from shopgauge.session import materialize
from shopgauge.star import Star

log = logging.getLogger(__name__)

WINDOW_DAYS = 90
NO_GAP_DAYS = 365.0
NO_REVIEW_SCORE = 3.0


def cutoff(star: Star, window_days: int = WINDOW_DAYS) -> Column:
    """The end of the observation window, as a one-value subquery that also reaches the scan's filters."""
    last = F.max("order_purchase_timestamp") - F.make_dt_interval(F.lit(window_days))
    return delivered(star).agg(last.alias("cutoff")).scalar()


def temporal_split(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Delivered orders, each in the observation window or in the prediction window after it."""
    observed = F.col("order_purchase_timestamp") <= cutoff(star, window_days)
    return delivered(star).select(
        "order_id", "customer_id", "order_purchase_timestamp",
        F.when(observed, "obs").otherwise("pred").alias("window"),
    )


def split_summary(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    ts = F.col("order_purchase_timestamp")
    return temporal_split(star, window_days).groupBy("window").agg(
        F.count(F.lit(1)).alias("orders"), F.min(ts).alias("first_order"), F.max(ts).alias("last_order")
    )


def require_observations(star: Star, window_days: int = WINDOW_DAYS) -> None:
    if temporal_split(star, window_days).where(F.col("window") == "obs").isEmpty():
        raise ValueError("no orders in the observation window: check the order dates")


def payment_types_by_person(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Number of distinct payment types of each person in the observation window.

    Types collapse per order, per session and per person in hash aggregates; their number needs no bound.
    """
    seen = delivered(star).where(F.col("order_purchase_timestamp") <= cutoff(star, window_days)).select("order_id", "customer_id")
    kinds = star.order_payments.where(F.col("payment_type").isNotNull()).select("order_id", "payment_type").distinct()
    people = star.customers.select("customer_id", PERSON).where(F.col(PERSON).isNotNull())
    sessions = kinds.join(seen, "order_id").select("customer_id", "payment_type").distinct()
    return (
        sessions.join(people, "customer_id").select(PERSON, "payment_type").distinct()
        .groupBy(PERSON).agg(F.count(F.lit(1)).alias("type_count"))
    )


def first_states(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    """The state of the session that ordered first and has a state (ties by session id), per person.

    A branch of its own, so that the sums of ``person_facts`` stay in hash aggregation: the first time of a person,
    the smallest session of that time, and that session's state.
    """
    ts = "order_purchase_timestamp"
    seen = delivered(star).where(F.col(ts) <= cutoff(star, window_days))
    people = star.customers.select("customer_id", PERSON, "customer_state").where(
        F.col(PERSON).isNotNull() & F.col("customer_state").isNotNull()
    )
    sessions = seen.groupBy("customer_id").agg(F.min(ts).alias("first_ts")).join(people, "customer_id")
    first = sessions.groupBy(PERSON).agg(F.min("first_ts").alias("first_ts"))
    chosen = sessions.join(first, [PERSON, "first_ts"]).groupBy(PERSON).agg(F.min("customer_id").alias("customer_id"))
    return people.join(chosen, [PERSON, "customer_id"]).select(PERSON, "customer_state")


# Sums of an order that the features are made of.
ORDER_SUMS = ["paid_cents", "paid_values", "installments", "installment_values", "score_sum", "scores"]


def orders_with_sums(star: Star) -> DataFrame:
    """Delivered orders with the sums of their payments and reviews, which are made before they meet the orders."""
    payments = star.order_payments.groupBy("order_id").agg(
        F.sum(cents("payment_value")).alias("paid_cents"),
        F.count("payment_value").alias("paid_values"),
        F.sum(F.col("payment_installments").cast("bigint")).alias("installments"),
        F.count("payment_installments").alias("installment_values"),
    )
    reviews = star.order_reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("scores")
    )
    orders = delivered(star).select("order_id", "customer_id", "order_purchase_timestamp")
    return orders.join(payments, "order_id", "left").join(reviews, "order_id", "left")


def person_facts(
    star: Star, window_days: int = WINDOW_DAYS, payment_types: bool = False, states: bool = False
) -> DataFrame:
    """Everything the features need, one row per person seen in the observation window.

    Payments and reviews are summed per order before they meet the orders, orders per session before they meet
    the customers. Orders of the prediction window go along only to tell who came back. What a caller does not
    select is pruned from the plan, down to the joins; ``payment_types`` and ``states`` add branches of their own.
    """
    ts = "order_purchase_timestamp"
    orders = orders_with_sums(star).withColumn("seen", F.col(ts) <= cutoff(star, window_days))

    def seen(name: str) -> Column:
        return F.when(F.col("seen"), F.col(name))

    sessions = (
        orders.groupBy("customer_id")
        .agg(
            F.count(seen("order_id")).alias("orders"),
            F.min(seen(ts)).alias("first_ts"),
            F.max(seen(ts)).alias("last_ts"),
            *[F.sum(seen(name)).alias(name) for name in ORDER_SUMS],
            F.max(~F.col("seen")).alias("came_back"),
        )
    )
    facts = (
        sessions.join(star.customers.select("customer_id", PERSON), "customer_id")
        .where(F.col(PERSON).isNotNull())
        .groupBy(PERSON)
        .agg(
            F.sum("orders").alias("frequency"),
            F.max("last_ts").alias("last_obs_purchase"),
            F.min("first_ts").alias("first_purchase"),
            *[F.sum(name).alias(name) for name in ORDER_SUMS],
            F.max("came_back").alias("came_back"),
        )
        .where(F.col("frequency") > 0)
    )
    if payment_types:
        kinds = payment_types_by_person(star, window_days)
        facts = facts.join(kinds, PERSON, "left").withColumn("type_count", F.coalesce("type_count", F.lit(0).cast("bigint")))
    return facts.join(first_states(star, window_days), PERSON, "left") if states else facts


def order_features(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Per person: state, orders, last and first purchase of the observation window."""
    return person_facts(star, window_days, states=True).select(
        PERSON, "customer_state", "frequency", "last_obs_purchase", "first_purchase"
    )


def with_payment_features(people: DataFrame) -> DataFrame:
    """Spend is 0 without payments, the means are then null; the mean order value is per payment."""
    return people.withColumns(
        {
            "monetary": money(F.coalesce("paid_cents", F.lit(0))),
            "avg_order_value": safe_ratio(money("paid_cents"), F.col("paid_values")),
            "avg_installments": safe_ratio(F.col("installments"), F.col("installment_values")),
            "payment_type_count": F.col("type_count"),
        }
    )


def payment_features(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    return with_payment_features(person_facts(star, window_days, payment_types=True)).select(
        PERSON, "monetary", "avg_order_value", "avg_installments", "payment_type_count"
    )


def with_review_features(people: DataFrame) -> DataFrame:
    """Mean score (3.0 without reviews) and number of scores."""
    return people.withColumns(
        {
            "avg_review_score": F.coalesce(
                safe_ratio(F.col("score_sum"), F.col("scores")), F.lit(NO_REVIEW_SCORE)
            ),
            "review_count": F.coalesce("scores", F.lit(0)),
        }
    )


def review_features(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    return with_review_features(person_facts(star, window_days)).select(PERSON, "avg_review_score", "review_count")


def with_tenure_and_gap(people: DataFrame) -> DataFrame:
    """Whole days between first and last purchase, and their mean per further order (365 for one order)."""
    tenure = whole_days("last_obs_purchase", "first_purchase")
    return people.withColumn("tenure_days", tenure).withColumn(
        "avg_days_between_orders",
        F.when(F.col("frequency") > 1, safe_ratio(F.col("tenure_days"), F.col("frequency") - 1))
        .otherwise(F.lit(NO_GAP_DAYS)),
    )


def tenure_and_gap(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    return with_tenure_and_gap(person_facts(star, window_days)).select(
        PERSON, "frequency", "tenure_days", "avg_days_between_orders"
    )


def with_label(people: DataFrame) -> DataFrame:
    """1 for persons without an order in the prediction window."""
    return people.withColumn(LABEL, (~F.col("came_back")).cast("bigint"))


def churn_label(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    return with_label(person_facts(star, window_days)).select(PERSON, LABEL)


def with_state_code(people: DataFrame) -> DataFrame:
    """Position of the state among the sorted states of these persons; -1 without a state.

    ``people`` is read twice, so it should be written. The distinct states are ranked as rows and joined back, by
    broadcast if Spark finds them small.
    """
    states = people.where(F.col("customer_state").isNotNull()).select("customer_state").distinct()
    place = F.row_number().over(Window.orderBy("customer_state"))  # over distinct states: a few narrow rows
    codes = states.select("customer_state", (place - 1).alias("_code"))
    code = F.coalesce("_code", F.lit(-1)).cast("bigint")
    return people.join(codes, "customer_state", "left").withColumn("state_encoded", code).select(*people.columns, "state_encoded")


def state_encoding(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    people = materialize(order_features(star, window_days).select(PERSON, "customer_state"), "states")
    return with_state_code(people)


def churn_features(star: Star, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Ten features from the observation window and the label; rows with a missing value are left out.

    The person's key is kept beside them. An empty observation window is an error; a churn rate outside the
    plausible band is logged.
    """
    facts = person_facts(star, window_days, payment_types=True, states=True)
    complete, rate = features_of(facts)
    if rate is None:
        require_observations(star, window_days)
    return complete


def features_of(facts: DataFrame) -> tuple[DataFrame, Row | None]:
    """Features and label of facts with payment types and states, and their churn rate; none without any facts."""
    people = with_label(with_tenure_and_gap(with_review_features(with_payment_features(facts))))
    kept = [PERSON, "customer_state", *[name for name in FEATURES if name != "state_encoded"], LABEL]
    written = materialize(people.select(*kept), "features")
    rate = churn_rate_check(written.dropna(subset=[c for c in kept if c != "customer_state"])).head()
    complete = with_state_code(written).select(PERSON, *FEATURES, LABEL).dropna()
    if rate["customers"] and not rate["in_band"]:
        log.warning("a churn rate of %s %% is outside the plausible band", rate["churn_rate_pct"])
    return complete, None if not rate["customers"] and written.isEmpty() else rate


def churn_rate_check(features: DataFrame, low: float = 10.0, high: float = 50.0) -> DataFrame:
    """Churn rate in percent and whether it is within the plausible band."""
    return features.agg(
        F.count(F.lit(1)).alias("customers"), (F.avg(F.col(LABEL).cast("double")) * 100).alias("rate")
    ).select(
        "customers", F.round("rate", 4).alias("churn_rate_pct"), F.col("rate").between(low, high).alias("in_band")
    )


# Range rules, required fields and defaults of a scoring request.
REQUEST_MINIMUM = {
    "frequency": 1, "monetary": 0, "avg_order_value": 0, "avg_installments": 1, "payment_type_count": 1,
    "avg_review_score": 1, "review_count": 0, "tenure_days": 0, "avg_days_between_orders": 0, "state_encoded": 0,
}
REQUEST_MAXIMUM = {"avg_review_score": 5}
REQUEST_DEFAULT = {
    "avg_review_score": 3.0, "review_count": 0, "tenure_days": 0, "avg_days_between_orders": 90.0, "state_encoded": 0,
}


def validate_features(requests: DataFrame) -> DataFrame:
    """Fill defaults and list, per request, the fields that are missing or out of range."""
    filled = requests.select(
        *[
            F.coalesce(F.col(name), F.lit(REQUEST_DEFAULT[name]).cast(requests.schema[name].dataType)).alias(name)
            if name in REQUEST_DEFAULT else F.col(name)
            for name in requests.columns
        ]
    )
    faults = []
    for name, least in REQUEST_MINIMUM.items():
        value = F.col(name)
        faults.append(F.when(value.isNull(), f"{name}: missing"))
        faults.append(F.when(value < least, f"{name}: below {least}"))
        if name in REQUEST_MAXIMUM:
            faults.append(F.when(value > REQUEST_MAXIMUM[name], f"{name}: above {REQUEST_MAXIMUM[name]}"))
    return filled.withColumn("violations", F.array_compact(F.array(*faults))).withColumn(
        "is_valid", F.size("violations") == 0
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests."""
    checked = validate_features(requests)
    return checked.where("is_valid").drop("violations", "is_valid"), checked.where("not is_valid")
