"""Ranks, order statistics and running aggregates over one global order, without a one-task window.

``lay_out`` sorts the rows by range into balanced parts and writes them once with their place (part number and
position). What follows needs one small row per part: the number of rows before a part turns a position into a
rank, and the running total of the parts before a part completes a running total inside it. A unique last sort
key makes the order total, and also lets a value shared by a third of all rows spread over many parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopgauge.session import materialize

PART, PLACE = "_part", "_place"
_LOW_BITS = (1 << 33) - 1
_BROADCAST_ROWS = 1_000_000


def lay_out(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` written in the order (``by``, ``order``) with its part number and its position in the part.

    Without ``parts`` adaptive execution sizes them by their bytes; it only ever merges neighbours.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in [*by, *order]]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    placed = (
        ranged.sortWithinPartitions(*keys)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
    )
    return materialize(placed, "ordered")


def _at_most(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side if its bound on rows allows, else as it is."""
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def _most_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_rank(laid: DataFrame, by: Sequence[str] = (), groups: int = 1) -> DataFrame:
    """Add ``rk`` (1..n inside ``by``) and ``n`` to a laid-out table.

    The join side has one row per part and group. ``groups`` states how many groups there are at most; while
    that keeps the side small it is broadcast.
    """
    parts = laid.groupBy(*by, PART).agg(F.min(PLACE).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *by, PART,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"),
        F.sum("_rows").over(group).alias("n"),
    )
    return (
        laid.join(_at_most(starts, groups * _most_parts(laid)), [*by, PART])
        .withColumn("rk", F.col(PLACE) + F.col("_start"))
        .drop("_start")
    )


def running(laid: DataFrame, by: Sequence[str], total: str, value: Column, how) -> DataFrame:
    """Running ``how`` (``F.sum`` or ``F.max``) of ``value`` up to and with each row, inside ``by``.

    ``by`` may name any number of groups. A group longer than a part is carried on from part to part; only
    parts that continue a group need such a carry, so there is at most one per part.
    """
    inside = Window.partitionBy(*by, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        laid.groupBy(*by, PART)
        .agg(how(value).alias("_total"))
        .withColumn("_carry", how("_total").over(earlier))
        .where(F.col("_carry").isNotNull())
        .select(*by, PART, "_carry")
    )
    local = laid.withColumn(total, how(value).over(inside))
    joined = local.join(_at_most(carry, _most_parts(laid)), [*by, PART], "left")
    if how is F.sum:
        complete = F.col(total) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        complete = F.greatest(F.col(total), F.col("_carry"))
    return joined.withColumn(total, complete).drop("_carry")
