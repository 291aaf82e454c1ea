"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a hash. A source takes whole copies of all its documents while its target allows, and one further
copy of the documents whose hash lies below a threshold. Tokens are summed by source and hash bucket, the bucket in
which the budget ends is found from the running sum, and only the documents of that bucket are summed again in finer
buckets, until a bucket holds one hash. Thresholds are nested: a larger budget takes all that a smaller one takes.
Nothing is sorted but the few sums of a source.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is hashed by its
text. Rows of equal hash (repeated rows) are taken together. Sources without words have target 0 and take nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopgauge.functions.ordering import lay_out, with_rank
from shopgauge.llm.tables import word_count
from shopgauge.session import materialize

#: Fixed values of the contract: weights of the sources in order, the mix's share of all words, most copies.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
_HASH_BITS, _STEP_BITS = 60, 10


def hash60(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, or of the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit(" "), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash, written once: later steps never read texts again."""
    return materialize(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h")
        ),
        "measured",
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``repeats`` times its source.

    The excess of capped sources is shared again by weight until none is above. Each round fetches three sums; the
    number of rounds is at most that of the sources, and two or three in practice.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    laid = lay_out(totals, [F.col("source").isNull(), "source"])
    place = F.pmod(F.col("rk") - 1, F.lit(len(weights))).cast("int")
    weighed = materialize(
        with_rank(laid).select(
            "source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).alias("weight")
        ),
        "weighed",
    )
    most = F.col("source_size") * repeats
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    budget, capped, rest, level = share * total, F.lit(False), -1, 0.0
    while True:
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).head()
        if sums[1] == rest or not sums[1]:
            break
        rest, level = sums[1], (budget - sums[0]) / sums[1]
        capped = most <= F.col("weight") * F.lit(level)
    target = F.when(capped, most.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def _at_source(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, threshold: documents whose hash is at most the threshold come nearest to ``wanted.rest`` words.

    ``wanted`` has a row (source, rest) per source with 0 < rest < its size.
    """
    # Each round keeps a row per source: the first hash of its boundary bucket and the words still wanted from it.
    edge = wanted.select("source", F.lit(0).cast("long").alias("low"), F.col("rest"))
    for used in range(_STEP_BITS, _HASH_BITS + 1, _STEP_BITS):
        shift = _HASH_BITS - used
        bucket = F.shiftright("h", shift)
        if used == _STEP_BITS:
            inside = sizes
        else:
            known = edge.select(F.col("source").alias("s"), F.shiftright("low", shift + _STEP_BITS).alias("outer"))
            here = F.shiftright(F.col("h"), shift + _STEP_BITS)
            inside = sizes.join(known, _at_source(F.col("source"), F.col("s")) & (here == F.col("outer")), "left_semi")
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most")
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("upto", F.sum("words").over(upto))
        wants = edge.select(F.col("source").alias("s"), "rest")
        crossed = running.join(wants, _at_source(F.col("source"), F.col("s"))).where(
            (F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest"))
        )
        edge = materialize(
            crossed.select(
                "source", F.shiftleft("bucket", shift).alias("low"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"),
                "words", "least", "most",
            ),
            "boundary",
        )
        if edge.where("least < most").isEmpty():
            break
    # The boundary bucket holds one hash now: it is taken if that comes nearer to what is wanted.
    nearer = F.col("words") - F.col("rest") < F.col("rest")
    return edge.select("source", F.when(nearer, F.col("least")).otherwise(F.col("least") - 1).alias("threshold"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (size times copies), one row per document."""
    sizes = measured(docs)
    plan = targets(sizes, weights, share, repeats).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"),
    )
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    ends = thresholds(sizes, plan.where("rest > 0").select(F.col("s").alias("source"), "rest"))
    rules = plan.join(ends, _at_source(F.col("source"), F.col("s")), "left").select(
        "s", "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold")
    )
    copies = F.col("whole") + (F.col("h") <= F.col("threshold")).cast("int")
    return (
        sizes.join(rules, _at_source(F.col("source"), F.col("s")))
        .withColumn("copies", copies)
        .select("doc_id", "h", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it.

    The copies are looked up by id and hash, so no hot source gathers texts in one task.
    """
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("of"), F.col("h").alias("hash"), "copies").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # out of the way of the names used here
    hashed = docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), hash60(F.col("doc_id"), F.col("text")).alias("h"))
    matched = hashed.join(taken, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")))
    return matched.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
