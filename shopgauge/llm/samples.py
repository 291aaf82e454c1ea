"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopgauge.llm.tables import remainder
from shopgauge.session import materialize


def learnable(doc_id: Column, divisor: int, held_out: int) -> Column:
    """Whether labels of this document may be learned from; false for a null id."""
    return F.coalesce(remainder(doc_id, divisor) != held_out, F.lit(False))


def is_held_out(doc_id: Column, divisor: int, held_out: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == held_out, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, divisor: int, held_out: int) -> DataFrame:
    """(text, label) of at most ``per_class`` learnable documents of either label, written once.

    The sample is the documents with the smallest hashes of their ids, so it does not depend on how rows are laid
    out. A document with several labels counts with the greatest; of several rows with one id all are taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    usable = rows.where(F.col("label").isin(0, 1) & learnable(F.col("id"), divisor, held_out))
    one = usable.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id"), F.lit(held_out))
    chosen = [one.where(F.col("label") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    ids = materialize(chosen[0].union(chosen[1]), "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class ids, so this side may be broadcast whatever the size of the corpus.
    return materialize(texts.join(F.broadcast(ids), "id").select("id", "text", "label"), "sample")


def labelled_ids(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """(id, label) of all learnable documents; one with several labels counts with the greatest."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    usable = rows.where(F.col("label").isin(0, 1) & learnable(F.col("id"), divisor, held_out))
    return usable.groupBy("id").agg(F.max("label").alias("label"))


def class_sizes(labels: DataFrame, label: str, divisor: int, held_out: int) -> tuple[int, int]:
    """Number of learnable documents with label 0 and 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    usable = rows.where(F.col("label").isin(0, 1) & learnable(F.col("id"), divisor, held_out))
    one = usable.groupBy("id").agg(F.max("label").alias("label"))
    got = one.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).head()
    return int(got[0] or 0), int(got[1] or 0)
