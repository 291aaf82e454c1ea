"""Tables of vectors: which rows count, vectors as arrays in Arrow batches, and merging of partial results in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopgauge.session import materialize

#: Entries must be smaller than this in size, so that scaled ones, and sums of squares of them, fit a long.
LARGEST = float(1 << 18)
#: Partial results that one task merges.
FAN_IN = 16


def usable(rows: DataFrame, vector: str, *others: str) -> tuple[DataFrame, int]:
    """``others`` and ``vector`` (array of doubles) of the rows that count, and the length of their vectors.

    Left out are null and empty vectors and those with a null, a NaN, an infinite entry or one of ``LARGEST`` or more
    in size. Should lengths differ, the most frequent one counts, of equally frequent ones the greatest; no rows: 0.
    """
    narrow = rows.select(*others, F.col(vector).cast("array<double>").alias(vector))
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False)))
    kept = narrow.where((F.size(vector) > 0) & fine)
    lengths = kept.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return kept, 0
    return kept.where(F.size(vector) == lengths[0]["n"]), lengths[0]["n"]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch of lists of ``length`` doubles as an array (rows, length)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def tree_merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], label: str) -> bytes | None:
    """One value out of all ``part``s (binary), ``FAN_IN`` to a task in each round; None if there are none.

    ``parts`` has a column ``at``, different numbers for the parts. What a task holds is bounded by the fan-in, and the
    driver gets the last round's single value.
    """
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for group, part in zip(batch.column("group").to_pylist(), batch.column("part").to_pylist()):
                found.setdefault(group, []).append(part)
                if len(found[group]) == FAN_IN:
                    found[group] = [merge(found[group])]
        if found:
            groups = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int64()), pa.array([merge(found[g]) for g in groups], pa.binary())], names=["at", "part"]
            )

    parts = materialize(parts, label)
    left = parts.agg(F.max("at")).first()[0]
    while left is not None and left > 0:
        left //= FAN_IN
        grouped = parts.select(F.floor(F.col("at") / FAN_IN).cast("long").alias("group"), "part")
        # Rows of a group meet in one task; the groups of a task are merged one by one.
        parts = materialize(grouped.repartition(min(left + 1, 200), "group").mapInArrow(merged, "at long, part binary"), label)
    rows = parts.select("part").limit(2).collect()
    return merge([bytes(r["part"]) for r in rows]) if rows else None
