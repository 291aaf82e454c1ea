"""Column types of the order star and of the records the operators return."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _TS, _MONEY = T.StringType(), T.IntegerType(), T.TimestampNTZType(), T.DecimalType(18, 2)

# Tables and columns of the star.
STAR_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", _S), ("customer_unique_id", _S), ("customer_zip_code_prefix", _S),
        ("customer_city", _S), ("customer_state", _S),
    ),
    "orders": _struct(
        ("order_id", _S), ("customer_id", _S), ("order_purchase_timestamp", _TS), ("order_status", _S),
        ("order_delivered_customer_date", _TS), ("order_estimated_delivery_date", _TS),
    ),
    "sellers": _struct(
        ("seller_id", _S), ("seller_zip_code_prefix", _S), ("seller_city", _S), ("seller_state", _S),
    ),
    "products": _struct(("product_id", _S), ("product_category_name", _S)),
    "category_translation": _struct(("product_category_name", _S), ("product_category_name_english", _S)),
    "order_items": _struct(
        ("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
        ("price", _MONEY), ("freight_value", _MONEY),
    ),
    "order_payments": _struct(
        ("order_id", _S), ("payment_sequential", _I), ("payment_type", _S),
        ("payment_installments", _I), ("payment_value", _MONEY),
    ),
    "order_reviews": _struct(("review_id", _S), ("order_id", _S), ("review_score", _I)),
}

# The keys that must be unique.
STAR_KEYS = {
    "orders": "order_id", "customers": "customer_id", "products": "product_id", "sellers": "seller_id",
    "category_translation": "product_category_name",
}

# Features of the churn model, in order.
FEATURES = [
    "frequency", "monetary", "avg_order_value", "avg_installments", "payment_type_count",
    "avg_review_score", "review_count", "tenure_days", "avg_days_between_orders", "state_encoded",
]
LABEL = "is_churned"
PERSON = "customer_unique_id"

# Fields of an experiment record, in order.
EXPERIMENT_RECORD = [
    "experiment_name", "metric_name", "control_size", "treatment_size", "control_mean", "treatment_mean",
    "absolute_lift", "relative_lift_pct", "test_statistic", "p_value", "ci_lower", "ci_upper",
    "is_significant", "mde", "statistical_power", "test_type",
]

# Parameters of a tuning trial.
TUNED_PARAMETERS = {
    "n_estimators": T.LongType(), "max_depth": T.LongType(), "learning_rate": T.DoubleType(),
    "subsample": T.DoubleType(), "colsample_bytree": T.DoubleType(), "min_child_weight": T.LongType(),
    "gamma": T.DoubleType(), "reg_alpha": T.DoubleType(), "reg_lambda": T.DoubleType(),
    "scale_pos_weight": T.DoubleType(),
}

TRIAL_SCHEMA = _struct(
    ("number", T.LongType()), ("value", T.DoubleType()),
    ("params", _struct(*TUNED_PARAMETERS.items())), ("state", _S),
)
