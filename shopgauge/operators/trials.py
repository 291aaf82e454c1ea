"""Tuning histories: best score so far and best trial, per study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shopgauge.functions.ordering import lay_out, running


def trial_running_max(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Best value up to each trial number; a failed trial counts as 0, and so does a negative best."""
    by = list(by)
    score = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    laid = lay_out(trials.select(*by, "number", score.alias("score")), ["number"], by)
    return running(laid, by, "running_max", F.col("score"), F.max).select(*by, "number", "running_max")


def best_trial(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """The trial with the highest value, the earliest one on ties; a missing value counts as 0."""
    by = list(by)
    score = F.coalesce("value", F.lit(0.0))
    highest = trials.groupBy(*by).agg(F.max(score).alias("_highest"))
    return (
        trials.join(highest, by).where(score == F.col("_highest"))
        .groupBy(*by)
        .agg(F.min("number").alias("number"), F.min_by("value", "number").alias("value"))
    )
