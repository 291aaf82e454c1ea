"""Tuning histories as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shopgauge.schema import TRIAL_SCHEMA


def load_trials(
    spark: SparkSession, path: str, schema: T.StructType = TRIAL_SCHEMA, one_array: bool = True
) -> DataFrame:
    """Trials, one row each, with the parameters as columns.

    ``one_array`` reads a file holding one JSON array (the form a single tuning run leaves behind); without it
    the files hold one trial per line and split over tasks.
    """
    raw = spark.read.schema(schema).option("multiLine", one_array).json(path)
    params = [f.name for f in schema["params"].dataType.fields]
    plain = [f.name for f in schema.fields if f.name != "params"]
    return raw.select(*plain, *[F.col(f"params.{name}").alias(name) for name in params])


def save_trials(trials: DataFrame, path: str) -> None:
    """One JSON object per line, nested parameters kept."""
    trials.write.mode("overwrite").option("ignoreNullFields", False).json(path)
