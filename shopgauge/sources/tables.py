"""Named tables: writing a frame, running SQL with parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shopgauge.schema import STAR_SCHEMAS
from shopgauge.star import Star

# The join and filter keys of the star's tables, as bucketing columns.
BUCKET_KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "order_reviews": "order_id",
}
_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_table(df: DataFrame, path: str, if_exists: str = "replace") -> DataFrame:
    """Write ``df`` as Parquet at ``path`` (replace, append or fail) and return the table read back."""
    df.write.mode(_MODES[if_exists]).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_as_bucketed_table(
    df: DataFrame, name: str, buckets: int, database: str = "default", if_exists: str = "replace"
) -> None:
    """Catalog table bucketed and sorted by the key it is joined on, so that such joins need no shuffle."""
    key = BUCKET_KEYS[name]
    df.write.mode(_MODES[if_exists]).bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


def save_star(star: Star, folder: str, if_exists: str = "replace") -> None:
    """Write the star as Parquet tables.

    Orders are laid out by purchase time, so that time filters skip files and row groups.
    """
    for name, df in star.tables().items():
        if name == "orders":
            df = df.repartitionByRange("order_purchase_timestamp").sortWithinPartitions("order_purchase_timestamp")
        df.write.mode(_MODES[if_exists]).parquet(f"{folder}/{name}")


def open_star(spark: SparkSession, folder: str) -> Star:
    """The star written by ``save_star``."""
    return Star(**{name: partial(spark.read.parquet, f"{folder}/{name}") for name in STAR_SCHEMAS})


def run_query(
    spark: SparkSession,
    text: str,
    params: Sequence[Any] | dict[str, Any] | None = None,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """SQL text over registered views, or over ``tables`` named in braces; ``?`` or ``:name`` markers take ``params``."""
    args = params if isinstance(params, dict) or params is None else list(params)
    return spark.sql(text, args=args, **(tables or {}))
