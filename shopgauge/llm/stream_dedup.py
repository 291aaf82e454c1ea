"""Exact deduplication with a stateful stream.

Documents arrive as a stream of small rows: the digest of the normalised text, the stable id and a locator. A streaming
aggregation keeps one state row per digest in RocksDB on the executors' disks, checkpointed to shared storage and never
expired: the smallest id seen with the locator of its row, and how many rows arrived. Every batch appends the states that it
changed; the last one of a digest holds. Only digests that were hit more than once go further: the full normalised texts
under them are compared, and should they differ, the texts themselves take the place of the digest. A row's place in its
digest's group is read off its locator, so documents without a copy are neither joined nor shuffled.

The locator is the row's file and number in it, where the documents are Parquet files that are only projected or filtered;
other documents are written once and located there. Texts are equal when they are identical after replacing each run of
the six ASCII spaces by one space.

Nulls: a null text counts as empty; a null doc_id comes after every id. Of repeated rows with the smallest id the one with
the smallest locator stays. An empty table gives an empty result. All other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopgauge.llm.tables import SPACE_RUN, broadcast_if_small
from shopgauge.session import materialize, scratch_path

_LAST = (1 << 63) - 1
#: The settings of the disk-backed state while a stream of this module runs.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every state partition reserves some megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lower-case hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _reads_files(docs: DataFrame) -> bool:
    """Whether every row is one row of a file: a scan, projected and filtered only."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and "_metadata" not in docs.columns


def located(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as they are), doc_id, text and the locator (file, number in the file) of every document."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    if _reads_files(docs):
        try:
            return docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("locator"))
        except AnalysisException:  # files of a format that does not number its rows
            pass
    stored = materialize(docs.select(whole.alias("row")), "located-documents")
    return stored.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), place.alias("locator"))


def _order(doc_id: Column | str) -> Column:
    return F.coalesce(doc_id, F.lit(_LAST))


def arrivals(placed: DataFrame) -> DataFrame:
    """One small row per located document, written once: doc_id, digest and locator."""
    return materialize(placed.select("doc_id", digest(F.col("text")).alias("digest"), "locator"), "arrivals")


def kept_state(stream: DataFrame) -> DataFrame:
    """The stateful part: per digest the smallest id with the locator of its row, and the number of rows; no watermark."""
    first = F.min(F.struct(_order("doc_id").alias("keep_order"), F.col("locator").alias("keep_locator")))
    return stream.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", "first.keep_order", "first.keep_locator", "group_size"
    )


def run_stream(spark: SparkSession, source: str, schema, checkpoint: str, out: str, files_per_batch: int = 64) -> None:
    """Take all files of ``source`` that have not been taken yet; append the changed states of each batch to ``out``.

    The checkpoint holds progress and state. After a failure, or when more files have come, the same call goes on;
    a batch that is run again writes over its own folder.
    """
    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/run={batch}")

    with _settings(spark, STATE_SETTINGS):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = (
            kept_state(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def states(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each digest."""
    schema = "digest string, keep_order long, keep_locator struct<file:long,number:long>, group_size long, batch long"
    rows = spark.read.schema(schema).parquet(f"{out}/run=*")
    newest = F.col("batch")
    return rows.groupBy("digest").agg(
        *[F.max_by(c, newest).alias(c) for c in ("keep_order", "keep_locator", "group_size")]
    )


def differing(placed: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` under which full texts differ. Texts of other digests are read, but go nowhere.

    The smallest and the greatest text of a digest are combined before rows are shuffled, so that a digest of many
    copies sends one row from each task.
    """
    texts = placed.select(normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(hits.select("digest"), "digest", "left_semi")
    return texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")


def _hits(placed: DataFrame, files_per_batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arrivals, the states of digests that were hit more than once, and those of them whose texts differ."""
    spark = placed.sparkSession
    rows = arrivals(placed)
    if rows.isEmpty():
        none = rows.select("digest", F.lit(0).cast("long").alias("keep_order"), F.col("locator").alias("keep_locator"), F.lit(0).cast("long").alias("group_size"))
        return rows, none, none.select("digest")
    folder, out = scratch_path(spark, "dedup-state"), scratch_path(spark, "dedup-changes")
    run_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema, folder, out, files_per_batch)
    hits = broadcast_if_small(materialize(states(spark, out).where("group_size > 1"), "dedup-hits"))
    return rows, hits, materialize(differing(placed, hits), "dedup-unequal")


def by_text(placed: DataFrame, unequal: DataFrame) -> DataFrame:
    """doc_id, digest, locator and state of the rows under ``unequal`` digests, by the texts themselves."""
    rows = placed.select("doc_id", normalised(F.col("text")).alias("text"), "locator")
    fine = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(unequal, "digest", "left_semi")
    first = F.min(F.struct(_order("doc_id").alias("keep_order"), F.col("locator").alias("keep_locator")))
    sums = fine.groupBy("digest", "text").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return fine.join(sums, ["digest", "text"]).select("doc_id", "digest", "locator", "first.keep_order", "first.keep_locator", "group_size")


def exact_groups(docs: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row per document."""
    placed = located(docs)
    rows, hits, unequal = _hits(placed, files_per_batch)
    result = rows.join(hits, "digest", "left")
    if not unequal.isEmpty():
        result = result.join(unequal, "digest", "left_anti").unionByName(by_text(placed, unequal))
    keep = F.coalesce("keep_order", _order("doc_id"))
    return result.select(
        "doc_id", F.when(keep < F.lit(_LAST), keep).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("locator") == F.col("keep_locator"), F.lit(True)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """The documents that stay: of equal texts, the row with the smallest doc_id. Rows are found by their locators."""
    placed = located(docs)
    rows, hits, unequal = _hits(placed, files_per_batch)
    gone = rows.join(hits, "digest")
    if not unequal.isEmpty():
        gone = gone.join(unequal, "digest", "left_anti").unionByName(by_text(placed, unequal))
    gone = materialize(gone.where(F.col("locator") != F.col("keep_locator")).select("locator"), "dedup-gone")
    return placed.join(broadcast_if_small(gone), "locator", "left_anti").select("row.*")
