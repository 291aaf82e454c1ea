"""Quality of a scored table: confusion counts, report per class, exact ROC-AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.functions.columns import array_round, safe_ratio, wide
from shopgauge.functions.ordering import lay_out, running

THRESHOLD = 0.5
CLASSES = {0: "Active", 1: "Churned"}


def confusion(scored: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    predicted, actual = F.col(probability) >= THRESHOLD, F.col(label) == 1
    return scored.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )


def roc_auc(scored: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; one row per group.

    Rows are first summed per distinct score; the negatives below a score are a running sum over the scores.
    Pairs are counted in halves to stay in integers. Null if a class is missing.
    """
    by = list(by)
    per_score = scored.groupBy(*by, F.col(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")
    )
    laid = lay_out(per_score, ["score"], by)
    halves = wide("positives") * (2 * (F.col("upto") - F.col("negatives")) + F.col("negatives"))
    return (
        running(laid, by, "upto", F.col("negatives"), F.sum)
        .groupBy(*by)
        .agg(
            F.sum(halves).cast("double").alias("halves"),
            F.sum("positives").alias("p"),
            F.sum("negatives").alias("n"),
        )
        .select(*by, F.try_divide(F.col("halves"), 2.0 * F.col("p") * F.col("n")).alias("roc_auc"))
    )


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    """0 where nothing was predicted or present."""
    return F.coalesce(safe_ratio(part, whole), F.lit(0.0))


def binary_metrics(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 and ROC-AUC, four decimals."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    counts = confusion(scored, label, probability)
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    rates = counts.select(
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    both = rates.unionByName(roc_auc(scored, label, probability), allowMissingColumns=True)
    return both.agg(*[array_round(F.max(name), 4).alias(name) for name in names])


def classification_report(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages; two decimals."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sides = {0: (tn, fn, fp), 1: (tp, fp, fn)}
    measures = {}
    for cls, (hit, false_alarm, missed) in sides.items():
        precision, recall = _share(hit, hit + false_alarm), _share(hit, hit + missed)
        measures[cls] = (precision, recall, _f1(precision, recall), hit + missed)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[array_round(v, 2).alias(k) for k, v in (("precision", precision), ("recall", recall), ("f1", f1))],
            support.alias("support"),
        )

    def averaged(weights: dict[int, Column]) -> list[Column]:
        total = weights[0] + weights[1]
        return [
            F.coalesce(F.try_divide(measures[0][i] * weights[0] + measures[1][i] * weights[1], total), F.lit(0.0))
            for i in range(3)
        ]

    accuracy = _share(tp + tn, n)
    rows = [row(CLASSES[cls], *measures[cls]) for cls in CLASSES]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, n))
    rows.append(row("macro avg", *averaged({0: F.lit(1), 1: F.lit(1)}), n))
    rows.append(row("weighted avg", *averaged({0: measures[0][3], 1: measures[1][3]}), n))
    return confusion(scored, label, probability).select(F.inline(F.array(*rows)))
