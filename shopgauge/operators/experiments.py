"""A/B-test statistics from unit-level outcomes.

Units are reduced to a few sums per experiment, metric and arm in one aggregation; everything after that is
arithmetic on one row per experiment and metric. Units are rows of experiment, metric, arm and outcome; without a
column ``metric`` the metric is named like its experiment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.functions.columns import array_round, safe_ratio
from shopgauge.functions.tails import chi_square_tail, normal_cdf, normal_quantile, t_critical, t_tail
from shopgauge.schema import EXPERIMENT_RECORD

CONFIDENCE = 0.95
POWER = 0.8
ARMS = {"control": "c", "treatment": "t"}
GROUP = ["experiment", "metric"]


def arm_statistics(units: DataFrame) -> DataFrame:
    """Size, total, mean, sample variance and deviation per experiment, metric and arm."""
    if "metric" not in units.columns:
        units = units.withColumn("metric", F.col("experiment"))
    return units.where(F.col("arm").isin(*ARMS)).groupBy(*GROUP, "arm").agg(
        F.count("outcome").alias("n"),
        F.sum("outcome").alias("total"),
        F.avg("outcome").alias("mean"),
        F.var_samp("outcome").alias("variance"),
        F.stddev_samp("outcome").alias("std"),
    )


def side_by_side(units: DataFrame) -> DataFrame:
    """One row per experiment and metric: every statistic of both arms, prefixed ``c_`` and ``t_``."""
    names = ["n", "total", "mean", "variance"]
    return arm_statistics(units).groupBy(*GROUP).agg(
        *[
            F.max(F.when(F.col("arm") == arm, F.col(name))).alias(f"{prefix}_{name}")
            for arm, prefix in ARMS.items()
            for name in names
        ]
    )


def _z(confidence: float) -> float:
    return normal_quantile(1 - (1 - confidence) / 2)


def lift() -> dict[str, Column]:
    """Absolute lift, and lift relative to the control mean in percent (0 unless that is positive)."""
    c, t = F.col("c_mean"), F.col("t_mean")
    return {
        "absolute_lift": t - c,
        "relative_lift_pct": F.when(c > 0, F.try_divide(t - c, c) * 100).otherwise(F.lit(0.0)),
    }


def chi_square() -> Column:
    """Chi-square of the 2x2 table with continuity correction; null if a margin is empty."""
    a, c = F.col("c_total"), F.col("t_total")
    b, d = F.col("c_n") - a, F.col("t_n") - c
    n = F.col("c_n") + F.col("t_n")
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    margins = F.col("c_n").cast("double") * F.col("t_n") * (a + c) * (b + d)
    return F.try_divide(n * off * off, margins)


def rate_standard_error() -> Column:
    """Unpooled standard error of the difference of two rates."""
    return F.sqrt(
        safe_ratio(F.col("c_mean") * (1 - F.col("c_mean")), F.col("c_n"))
        + safe_ratio(F.col("t_mean") * (1 - F.col("t_mean")), F.col("t_n"))
    )


def mean_standard_error() -> Column:
    return F.sqrt(safe_ratio(F.col("c_variance"), F.col("c_n")) + safe_ratio(F.col("t_variance"), F.col("t_n")))


def welch_t() -> Column:
    """Control minus treatment: its sign is opposite to the lift."""
    return F.try_divide(F.col("c_mean") - F.col("t_mean"), mean_standard_error())


def welch_df() -> Column:
    c, t = safe_ratio(F.col("c_variance"), F.col("c_n")), safe_ratio(F.col("t_variance"), F.col("t_n"))
    return F.try_divide(
        (c + t) * (c + t), safe_ratio(c * c, F.col("c_n") - 1) + safe_ratio(t * t, F.col("t_n") - 1)
    )


def rate_mde(confidence: float = CONFIDENCE) -> Column:
    """Smallest difference of rates detectable with 80 % power, from the control rate and the smaller arm."""
    z = _z(confidence) + normal_quantile(POWER)
    p = F.col("c_mean")
    return F.lit(z) * F.sqrt(safe_ratio(2 * p * (1 - p), F.least("c_n", "t_n")))


def mean_mde(confidence: float = CONFIDENCE) -> Column:
    z = _z(confidence) + normal_quantile(POWER)
    pooled = F.sqrt((F.col("c_variance") + F.col("t_variance")) / 2)
    return F.lit(z) * pooled * F.sqrt(safe_ratio(F.lit(1), F.col("c_n")) + safe_ratio(F.lit(1), F.col("t_n")))


def rate_power_argument(confidence: float = CONFIDENCE) -> Column:
    n = F.col("c_n") + F.col("t_n")
    pooled = safe_ratio(F.col("c_total") + F.col("t_total"), n)
    null_error = F.sqrt(safe_ratio(2 * pooled * (1 - pooled), F.least("c_n", "t_n")))
    distance = F.abs(F.col("t_mean") - F.col("c_mean")) - F.lit(_z(confidence)) * null_error
    return F.try_divide(distance, rate_standard_error())


def mean_power_argument(confidence: float = CONFIDENCE) -> Column:
    error = mean_standard_error()
    distance = F.abs(F.col("t_mean") - F.col("c_mean")) - F.lit(_z(confidence)) * error
    return F.try_divide(distance, error)


def _interval(half_width: Column) -> dict[str, Column]:
    diff = F.col("t_mean") - F.col("c_mean")
    return {"ci_lower": diff - half_width, "ci_upper": diff + half_width}


def proportion_statistics(units: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """All unrounded statistics of 0/1 outcomes, one row per experiment and metric."""
    stats = side_by_side(units).withColumns(
        {
            **lift(),
            **_interval(F.lit(_z(confidence)) * rate_standard_error()),
            "test_statistic": chi_square(),
            "mde": rate_mde(confidence),
            "power_argument": rate_power_argument(confidence),
        }
    )
    return stats.withColumns(
        {"p_value": chi_square_tail("test_statistic"), "statistical_power": normal_cdf("power_argument")}
    )


def mean_statistics(units: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """All unrounded statistics of numeric outcomes, one row per experiment and metric.

    The interval uses the t quantile at the smaller arm's degrees of freedom, not at the test's.
    """
    stats = side_by_side(units).withColumns(
        {
            **lift(),
            "standard_error": mean_standard_error(),
            "test_statistic": welch_t(),
            "degrees_of_freedom": welch_df(),
            "ci_quantile": F.lit(1 - (1 - confidence) / 2),
            "ci_df": (F.least("c_n", "t_n") - 1).cast("double"),
            "mde": mean_mde(confidence),
            "power_argument": mean_power_argument(confidence),
        }
    )
    stats = stats.withColumns(
        {
            "p_value": t_tail("test_statistic", "degrees_of_freedom"),
            "t_critical": t_critical("ci_quantile", "ci_df"),
            "statistical_power": normal_cdf("power_argument"),
        }
    )
    return stats.withColumns(_interval(F.col("t_critical") * F.col("standard_error")))


# Decimals of a report record by kind of metric.
RATE_DIGITS = {
    "control_mean": 5, "treatment_mean": 5, "absolute_lift": 5, "relative_lift_pct": 2, "test_statistic": 4,
    "p_value": 6, "ci_lower": 5, "ci_upper": 5, "mde": 5, "statistical_power": 4,
}
MEAN_DIGITS = {
    "control_mean": 2, "treatment_mean": 2, "absolute_lift": 2, "relative_lift_pct": 2, "test_statistic": 4,
    "p_value": 6, "ci_lower": 4, "ci_upper": 4, "mde": 4, "statistical_power": 4,
}


def _records(stats: DataFrame, test_type: str, digits: dict[str, int], confidence: float) -> DataFrame:
    full = stats.withColumns(
        {
            "experiment_name": F.col("experiment"),
            "metric_name": F.col("metric"),
            "control_size": F.col("c_n"),
            "treatment_size": F.col("t_n"),
            "control_mean": F.col("c_mean"),
            "treatment_mean": F.col("t_mean"),
            "is_significant": F.col("p_value") < (1 - confidence),
            "test_type": F.lit(test_type),
        }
    )
    return full.select(
        *[array_round(name, digits[name]).alias(name) if name in digits else F.col(name) for name in EXPERIMENT_RECORD]
    )


def proportion_report(units: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    return _records(proportion_statistics(units, confidence), "chi_square", RATE_DIGITS, confidence)


def mean_report(units: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    return _records(mean_statistics(units, confidence), "t_test", MEAN_DIGITS, confidence)


def experiment_report(rate_units: DataFrame, value_units: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """One record per experiment and metric, the test chosen by the kind of metric."""
    return proportion_report(rate_units, confidence).unionByName(mean_report(value_units, confidence))


# Verdict texts; the first place is the significance level, the second the lift.
REJECTED = "We reject H₀ — the treatment effect is statistically significant at α={}. The {}% lift is real."
NOT_REJECTED = (
    "We fail to reject H₀ — insufficient evidence at α={}. "
    "The observed lift of {}% may be due to chance."
)


def significance_verdict(report: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """A sentence per record; ``confidence`` is that of the report."""
    shown = F.regexp_replace(F.col("relative_lift_pct").cast("string"), r"\.0$", "")
    level = format(round(1 - confidence, 10), "g")

    def sentence(text: str) -> Column:
        before, between, after = text.split("{}")
        return F.concat(F.lit(before + level + between), shown, F.lit(after))

    return report.select(
        "experiment_name", "is_significant",
        F.when(F.col("is_significant"), sentence(REJECTED)).otherwise(sentence(NOT_REJECTED)).alias("verdict"),
    )


# Rounded normal quantiles of the sample size rule.
SIZE_Z_ALPHA, SIZE_Z_BETA = 1.96, 0.84


def sample_size(base: Column, relative_lift: Column) -> Column:
    """Units per arm to detect a relative lift of a base rate; null if the lifted rate exceeds 1."""
    lifted = base * (1 + relative_lift)
    middle = (base + lifted) / 2
    spread = F.lit(SIZE_Z_ALPHA) * F.sqrt(F.greatest(2 * middle * (1 - middle), F.lit(0.0))) + F.lit(
        SIZE_Z_BETA
    ) * F.sqrt(F.greatest(base * (1 - base) + lifted * (1 - lifted), F.lit(0.0)))
    gap = lifted - base
    needed = F.ceil(F.try_divide(spread * spread, gap * gap))
    return F.when((lifted <= 1) & (base > 0), needed)


def sample_size_grid(units: DataFrame, lifts_pct: range = range(5, 101)) -> DataFrame:
    """Units per arm for every experiment's control rate (in whole percent) and every lift."""
    base = F.floor(F.col("c_mean") * 100 + 0.5)
    grid = side_by_side(units).select(
        "experiment", base.cast("bigint").alias("base_pct"),
        F.explode(F.sequence(F.lit(lifts_pct.start).cast("bigint"), F.lit(lifts_pct.stop - 1).cast("bigint")))
        .alias("lift_pct"),
    )
    return grid.withColumn(
        "per_arm", sample_size(F.col("base_pct") / F.lit(100.0), F.col("lift_pct") / F.lit(100.0)).cast("bigint")
    )
