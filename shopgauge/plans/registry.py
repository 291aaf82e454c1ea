"""Every report as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shopgauge.functions.columns import cents
from shopgauge.operators import (
    churn, customers, experiments, increments, learning, model_metrics, sales, scoring, service, statements, trials,
)
from shopgauge.schema import LABEL, PERSON
from shopgauge.session import materialize, scratch_path
from shopgauge.sources import csv_star, tables, testdata, trial_files
from shopgauge.star import Star

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that results compare equal across engines."""
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def on_star(operator: Callable[..., DataFrame], **options) -> Query:
    @wraps(operator)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(operator(testdata.star(spark, sf_dir), **options))

    return query


def sales_queries() -> dict[str, Query]:
    return {
        "revenue_by_state": on_star(sales.revenue_by_state),
        "monthly_revenue_growth": on_star(sales.monthly_revenue_growth),
        "top_sellers": on_star(sales.top_sellers),
        "payment_method_analysis": on_star(sales.payment_method_analysis),
        "kpis": on_star(sales.kpis),
        "revenue_trend": on_star(sales.revenue_trend),
        "top_states": on_star(sales.top_states),
        "top_categories": on_star(sales.top_categories),
        "payment_mix": on_star(sales.payment_mix),
        "recent_orders": on_star(sales.recent_orders),
        "cumulative_revenue": on_star(sales.cumulative_revenue),
        "dataset_summary": on_star(sales.dataset_summary, focus_state="NATION_3"),
        "state_revenue_share": on_star(sales.state_revenue_share),
        "payment_type_share": on_star(sales.payment_type_share),
    }


def customer_queries() -> dict[str, Query]:
    return {
        "cohort_retention_counts": on_star(customers.cohort_retention_counts),
        "repeat_purchase_rate": on_star(customers.repeat_purchase_rate),
        "monthly_retention": on_star(customers.monthly_retention),
        "rfm_segments": on_star(customers.rfm_segments),
        "clv_distribution": on_star(customers.clv_distribution),
        "rfm_scores": on_star(customers.rfm_scores),
        "rfm_segment_counts": on_star(customers.rfm_segment_counts),
        "cohort_window": on_star(customers.cohort_window),
        "cohort_matrix": on_star(customers.cohort_matrix),
        "month_dropoff": on_star(customers.month_dropoff),
        **{f"sketched_{name}": on_sketches(report) for name, report in COHORT_REPORTS.items()},
    }


COHORT_REPORTS = {
    "cohort_retention_counts": customers.cohort_retention_counts,
    "cohort_window": customers.cohort_window,
    "cohort_matrix": customers.cohort_matrix,
    "month_dropoff": customers.month_dropoff,
}


def on_sketches(report: Callable[[DataFrame], DataFrame]) -> Query:
    """A cohort report out of sketches of the months, which are stored in two parts of the customers and merged."""

    @wraps(report)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = testdata.star(spark, sf_dir)
        path = scratch_path(spark, "sketches")
        for part in range(2):
            some = star.customers.where(F.pmod(F.hash(PERSON), F.lit(2)) == part)
            rows = customers.month_sketches(Star(**{**star.tables(), "customers": some}))
            stored = tables.write_table(rows, path, "append")
        return plain(report(customers.cohorts_from_sketches(stored)))

    return query


def service_queries() -> dict[str, Query]:
    return {
        "category_performance": on_star(service.category_performance),
        "delivery_performance": on_star(service.delivery_performance),
        "review_sentiment": on_star(service.review_sentiment),
        "seller_scorecard": on_star(service.seller_scorecard),
        "seller_late_flag": on_star(service.seller_late_flag),
        "late_vs_review": on_star(service.late_vs_review),
        "seller_pareto": on_star(service.seller_pareto),
    }


def statement(name: str) -> Query:
    return lambda spark, sf_dir: plain(statements.run(spark, testdata.star(spark, sf_dir), name))


def statement_queries() -> dict[str, Query]:
    """The reports by their SQL text."""
    return {f"sql_{name}": statement(name) for name in statements.STATEMENTS}


def source_queries() -> dict[str, Query]:
    return {
        "load_star": load_star,
        "normalize_headers": normalize_headers,
        "parse_timestamps": parse_timestamps,
        "write_table": write_table,
        "bucketed_join": bucketed_join,
        "run_query": run_query,
        "load_trials": load_trials,
    }


def load_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star written as CSV files and read back by table name: rows, keys and the sum of one column of values.

    The values are days of purchase and of delivery, whole cents, installments and scores; names count as rows.
    """
    folder = scratch_path(spark, "csv")
    csv_star.save_star_csv(testdata.star(spark, sf_dir), folder)

    def days(name: str):
        return F.coalesce(F.date_diff(F.col(name), F.lit("1970-01-01").cast("date")), F.lit(0))

    values = {
        "orders": days("order_purchase_timestamp") + days("order_delivered_customer_date"),
        "order_items": cents("price"),
        "order_payments": cents("payment_value") + F.col("payment_installments"),
        "order_reviews": F.col("review_score"),
        "customers": F.col("customer_state").isNotNull().cast("int"),
        "sellers": F.col("seller_state").isNotNull().cast("int"),
        "products": F.col("product_category_name").isNotNull().cast("int"),
        "category_translation": F.col("product_category_name_english").isNotNull().cast("int"),
    }
    counts = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"), F.count(df.columns[0]).alias("keyed_rows"),
            F.sum(values[name].cast("bigint")).alias("value_sum"),
        )
        .select(F.lit(name).alias("table_name"), "row_count", "keyed_rows", "value_sum")
        for name, df in csv_star.load_star(spark, folder).tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)


def normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments = testdata.star(spark, sf_dir).order_payments.select("order_id", "payment_type")
    return csv_star.normalize_headers(payments.toDF(" Order_ID", "PAYMENT_Type  "))


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order timestamps as text, some of the delivery dates spoiled, parsed again."""
    orders = testdata.star(spark, sf_dir).orders
    delivered_text = F.col("order_delivered_customer_date").cast("string")
    text = orders.select(
        "order_id",
        F.col("order_purchase_timestamp").cast("string").alias("purchased"),
        F.when(F.col("order_id") % 10 == 3, "soon").otherwise(delivered_text).alias("delivered"),
    )
    return plain(
        text.select(
            "order_id",
            csv_star.strict_timestamp(F.col("purchased")).alias("purchased"),
            csv_star.lenient_timestamp(F.col("delivered")).alias("delivered"),
        )
    )


def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered orders written in place of shipped ones, then processing ones appended."""
    orders = testdata.star(spark, sf_dir).orders.select("order_id", "order_status")
    path = scratch_path(spark, "table")
    for status, if_exists in (("shipped", "fail"), ("delivered", "replace"), ("processing", "append")):
        stored = tables.write_table(orders.where(F.col("order_status") == status), path, if_exists)
    return stored


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments summed by order and joined to their orders, both from tables bucketed by the order: nothing is shuffled."""
    star, path = testdata.star(spark, sf_dir), scratch_path(spark, "buckets")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"create database {database} location '{path}'")
    for name in ("orders", "order_payments"):
        tables.save_as_bucketed_table(star.tables()[name], name, 8, database)
    paid = spark.table(f"{database}.order_payments").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payments"), F.sum(cents("payment_value")).alias("paid_cents")
    )
    return spark.table(f"{database}.orders").join(paid.hint("merge"), "order_id").select(
        "order_id", "order_status", "payments", "paid_cents"
    )


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = testdata.star(spark, sf_dir)
    return tables.run_query(
        spark,
        "select payment_type, count(*) as payments from {paid} join {placed} using (order_id) "
        "where order_status = :status and payment_installments >= :installments group by payment_type",
        {"status": "shipped", "installments": 1},
        {"paid": star.order_payments, "placed": star.orders},
    )


def load_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial histories stored as nested JSON and read back with the parameters as columns."""
    trials = testdata.trials(spark, sf_dir)
    path = scratch_path(spark, "trials")
    trial_files.save_trials(trials, path)
    return trial_files.load_trials(spark, path, trials.schema, one_array=False)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_features(testdata.star(spark, sf_dir))


def churn_features_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features out of stored months: a base a year before the cutoff, one at the cutoff's month made from it."""
    folder = scratch_path(spark, "months")
    increments.add_months(testdata.star(spark, sf_dir), folder)
    month = increments.month_of(increments.cutoff(spark, folder))
    base = increments.advance(spark, folder, month, increments.advance(spark, folder, month - 12))
    return increments.churn_features(spark, folder, base=base)


def with_closed_form_score(rows: DataFrame) -> DataFrame:
    """A score that SQL can state, in thousandths, so that every band edge is met exactly."""
    mixed = F.pmod(F.col(PERSON) * 37 + F.col("frequency") * 113, F.lit(1001))
    return rows.withColumn("probability", mixed.cast("double") / 1000.0)


def on_scores(operator: Callable[..., DataFrame], *args) -> Query:
    @wraps(operator)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(with_closed_form_score(features(spark, sf_dir)), *args)

    return query


def churn_queries() -> dict[str, Query]:
    return {
        "temporal_split": on_star(churn.split_summary),
        "order_features": on_star(churn.order_features),
        "payment_features": on_star(churn.payment_features),
        "review_features": on_star(churn.review_features),
        "tenure_and_gap": on_star(churn.tenure_and_gap),
        "churn_label": on_star(churn.churn_label),
        "state_encoding": on_star(churn.state_encoding),
        "churn_features": features,
        "churn_features_by_month": churn_features_by_month,
        "churn_rate_check": lambda spark, sf_dir: churn.churn_rate_check(features(spark, sf_dir)),
        "validate_features": validate_features,
        "risk_bands": on_scores(scoring.risk_bands),
        "high_risk_top20": on_scores(scoring.high_risk),
        "risk_histogram": on_scores(scoring.risk_histogram),
        "batch_score": on_scores(scoring.batch_score),
        "binary_metrics": on_scores(model_metrics.binary_metrics, LABEL, "probability"),
        "classification_report": on_scores(model_metrics.classification_report, LABEL, "probability"),
    }


def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = churn.validate_features(testdata.request_rows(features(spark, sf_dir)))
    return checked.withColumn("violations", F.array_join("violations", "; "))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All persons, and those to train and to test on."""
    split = materialize(learning.stratified_split(features(spark, sf_dir)), "split")
    train, test = (split.where(F.col("part") == part).drop("part") for part in ("train", "test"))
    return split.drop("part"), train, test


_fitted: dict[tuple[str, str], learning.ChurnModel] = {}


def _fit(spark: SparkSession, sf_dir: str) -> tuple[learning.ChurnModel, DataFrame, DataFrame]:
    """The model with default parameters, all persons and the test part. The model is kept for the session's other queries."""
    people, train, test = _split(spark, sf_dir)
    model = _fitted[spark.sparkContext.applicationId, sf_dir] = learning.train(train, test)
    return model, people, test


def _model(spark: SparkSession, sf_dir: str) -> learning.ChurnModel:
    return _fitted.get((spark.sparkContext.applicationId, sf_dir)) or _fit(spark, sf_dir)[0]


def _model_and_persons(spark: SparkSession, sf_dir: str) -> tuple[learning.ChurnModel, DataFrame]:
    """The model and all persons: those it was fitted from if that is done now, read anew if it was kept."""
    kept = _fitted.get((spark.sparkContext.applicationId, sf_dir))
    return (kept, features(spark, sf_dir)) if kept else _fit(spark, sf_dir)[:2]


def _model_and_test(spark: SparkSession, sf_dir: str) -> tuple[learning.ChurnModel, DataFrame]:
    """The model and the test part, likewise."""
    kept = _fitted.get((spark.sparkContext.applicationId, sf_dir))
    return (kept, _split(spark, sf_dir)[2]) if kept else _fit(spark, sf_dir)[::2]


def _scored(model: learning.ChurnModel, rows: DataFrame) -> DataFrame:
    """Rows with their probabilities, made once."""
    return materialize(model.score(rows), "scored")


def train_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, _fit(spark, sf_dir)[0])


def _metrics(spark: SparkSession, model: learning.ChurnModel) -> DataFrame:
    return spark.createDataFrame(
        [(name, float(value)) for name, value in model.metrics.items()], "metric string, value double"
    )


def tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, _ = _split(spark, sf_dir)
    trials, _ = learning.tune(train)
    frame = learning.trials_frame(spark, trials)
    return frame.select("number", "value", *[F.col("params")[name].alias(name) for name in learning.SEARCH_SPACE], "state")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.feature_importance(spark, _model(spark, sf_dir))


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.permutation_importance(*_model_and_test(spark, sf_dir))


def mean_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the margins of the test part, on the mean over persons."""
    return learning.mean_attribution(*_model_and_test(spark, sf_dir))


def save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all persons by the model as fitted and as stored and read back."""
    model, people = _model_and_persons(spark, sf_dir)
    people = materialize(people, "persons")
    path = scratch_path(spark, "model")
    learning.save_model(model, path)
    loaded = learning.load_model(path)
    before = _scored(model, people).select(PERSON, F.col("probability").alias("fitted"))
    after = _scored(loaded, people).select(PERSON, F.col("probability").alias("loaded"))
    return before.join(after, PERSON).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("fitted") != F.col("loaded")).alias("different")
    )


def _run_log(spark: SparkSession, model: learning.ChurnModel) -> DataFrame:
    path = scratch_path(spark, "runs")
    learning.log_run(spark, model, path)
    return learning.read_runs(spark, path).select("run_name", F.explode("metrics").alias("metric", "value"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_log(spark, _model(spark, sf_dir))


def churn_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = learning.churn_training(features(spark, sf_dir), scratch_path(spark, "training"))
    return run.importance


def on_model(operator: Callable[..., DataFrame]) -> Query:
    @wraps(operator)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(_scored(*_model_and_persons(spark, sf_dir)))

    return query


def validated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scoring request: accepted ones with the model's answer, rejected ones with their faults."""
    model, people = _model_and_persons(spark, sf_dir)
    accepted, rejected = churn.split_requests(testdata.request_rows(people))
    answers = scoring.batch_score(_scored(model, accepted))
    faults = rejected.select(PERSON, F.array_join("violations", "; ").alias("violations"))
    return answers.unionByName(faults, allowMissingColumns=True)


_rule_fitted: dict[tuple[str, str], learning.ChurnModel] = {}


def _rule_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All persons, and those to train and to test on."""
    rule = features(spark, sf_dir).withColumn(LABEL, (F.col("payment_type_count") >= 3).cast("bigint"))
    split = materialize(learning.stratified_split(rule), "split")
    train, test = (split.where(F.col("part") == part).drop("part") for part in ("train", "test"))
    return split.drop("part"), train, test


def _rule_fit(spark: SparkSession, sf_dir: str) -> tuple[learning.ChurnModel, DataFrame, DataFrame]:
    """A model for a label that one feature decides: SQL can state all of its answers. With all persons and the test part.

    Leaves may be as small as they come. Else a table of few persons, once the rule is learned, leaves too little weight
    on one side of it, and trees would split on what else goes with the rule.
    """
    people, train, test = _rule_split(spark, sf_dir)
    model = _rule_fitted[spark.sparkContext.applicationId, sf_dir] = learning.train(train, test, {"min_child_weight": 0})
    return model, people, test


def _rule_model(spark: SparkSession, sf_dir: str) -> learning.ChurnModel:
    return _rule_fitted.get((spark.sparkContext.applicationId, sf_dir)) or _rule_fit(spark, sf_dir)[0]


def _rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons with the probabilities of the rule's model; read anew if it was kept."""
    kept = _rule_fitted.get((spark.sparkContext.applicationId, sf_dir))
    return _scored(kept, features(spark, sf_dir)) if kept else _scored(*_rule_fit(spark, sf_dir)[:2])


def rule_train_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, _rule_model(spark, sf_dir))


def rule_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.feature_importance(spark, _rule_model(spark, sf_dir))


def rule_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _rule_fitted.get((spark.sparkContext.applicationId, sf_dir))
    return learning.permutation_importance(*((kept, _rule_split(spark, sf_dir)[2]) if kept else _rule_fit(spark, sf_dir)[::2]))


def rule_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_log(spark, _rule_model(spark, sf_dir))


def rule_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.batch_score(_rule_scored(spark, sf_dir)).select(PERSON, "is_churned", "risk_level")


def rule_risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_histogram(_rule_scored(spark, sf_dir))


def learning_queries() -> dict[str, Query]:
    return {
        "stratified_split": lambda spark, sf_dir: learning.stratified_split(features(spark, sf_dir)).select(
            PERSON, LABEL, "part"
        ),
        "stratified_folds": lambda spark, sf_dir: learning.stratified_folds(features(spark, sf_dir)).select(
            PERSON, LABEL, F.col("fold").cast("bigint").alias("fold")
        ),
        "train_churn": train_churn,
        "tune": tune,
        "feature_importance": feature_importance,
        "permutation_importance": permutation_importance,
        "save_load_model": save_load_model,
        "run_log": run_log,
        "churn_training": churn_training,
        "mean_attribution": mean_attribution,
        "model_high_risk": on_model(scoring.high_risk),
        "model_batch_score": on_model(scoring.batch_score),
        "model_risk_histogram": on_model(scoring.risk_histogram),
        "validated_scores": validated_scores,
        "rule_train_churn": rule_train_churn,
        "rule_feature_importance": rule_feature_importance,
        "rule_permutation_importance": rule_permutation_importance,
        "rule_run_log": rule_run_log,
        "rule_batch_score": rule_batch_score,
        "rule_risk_histogram": rule_risk_histogram,
        "trial_running_max": lambda spark, sf_dir: trials.trial_running_max(testdata.trials(spark, sf_dir)),
        "best_trial": lambda spark, sf_dir: trials.best_trial(testdata.trials(spark, sf_dir)),
    }


def arm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = testdata.rate_units(spark, sf_dir).unionByName(testdata.value_units(spark, sf_dir))
    numbers = experiments.arm_statistics(units)
    return numbers.select(
        "experiment", "arm", "n", *[F.round(name, 6).alias(name) for name in ("total", "mean", "variance", "std")]
    )


def _statistics(kind: str, columns: dict[str, int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == "rate":
            stats = experiments.proportion_statistics(testdata.rate_units(spark, sf_dir))
        else:
            stats = experiments.mean_statistics(testdata.value_units(spark, sf_dir))
        return stats.select("experiment", *[F.round(name, digits).alias(name) for name, digits in columns.items()])

    return query


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.experiment_report(testdata.rate_units(spark, sf_dir), testdata.value_units(spark, sf_dir))


def experiment_queries() -> dict[str, Query]:
    return {
        "arm_statistics": arm_statistics,
        "proportion_test": _statistics("rate", {"test_statistic": 8, "p_value": 8}),
        "proportion_ci": _statistics("rate", {"ci_lower": 8, "ci_upper": 8}),
        "lift": _statistics("rate", {"absolute_lift": 8, "relative_lift_pct": 6}),
        "welch_t_test": _statistics("mean", {"test_statistic": 6, "degrees_of_freedom": 3, "p_value": 6}),
        "mean_ci": _statistics("mean", {"t_critical": 6, "ci_lower": 5, "ci_upper": 5}),
        "mde_proportion": _statistics("rate", {"mde": 8}),
        "mde_mean": _statistics("mean", {"mde": 6}),
        "power_proportion": _statistics("rate", {"power_argument": 7, "statistical_power": 7}),
        "power_mean": _statistics("mean", {"power_argument": 6, "statistical_power": 6}),
        "experiment_report": _report,
        "sample_size_grid": lambda spark, sf_dir: experiments.sample_size_grid(testdata.rate_units(spark, sf_dir)),
        "significance_verdict": lambda spark, sf_dir: experiments.significance_verdict(_report(spark, sf_dir)),
    }


def all_queries() -> dict[str, Query]:
    return {
        **source_queries(), **statement_queries(), **sales_queries(), **customer_queries(), **service_queries(),
        **churn_queries(), **learning_queries(), **experiment_queries(),
    }
