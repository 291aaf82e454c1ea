"""Session settings and the shared scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}  # temporary folder by application, of local sessions without a shared one


def build_session(app_name: str = "shopgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _application_folder(spark: SparkSession) -> str:
    """This application's part of the folder that every executor can read.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session without one falls back to a
    temporary folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder shared by the executors")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="shopgauge-")
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's scratch folder."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote below ``scratch_path``.

    For the end of a job: frames that read from there fail afterwards.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Used where a result is read more than once, or where later steps rely on how its rows were laid out: the
    written files outlive any executor, so a lost one never recomputes (or reorders) what was already read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
