"""The star from a folder of CSV files, one per table."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shopgauge.schema import STAR_SCHEMAS
from shopgauge.star import Star

log = logging.getLogger(__name__)

STRICT_TIMES = {"order_purchase_timestamp"}
# Columns that no operator reads; a file may lack them, and they are null then.
DESCRIPTIVE = {"customer_zip_code_prefix", "customer_city", "seller_zip_code_prefix", "seller_city", "review_id", "payment_sequential"}
# The file names a star folder may use for a table; {} is the table's short name. A name without a
# prefix is taken before one with a prefix.
FILE_PATTERNS = ["{}.csv", "*_{}_dataset.csv", "*_{}.csv"]
FILE_STEMS = {"category_translation": "category_name_translation"}


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name."""
    return df.toDF(*[name.strip().lower() for name in df.columns])


def strict_timestamp(text: Column) -> Column:
    """Zone-free timestamp; text that is not one ends the query."""
    parsed = text.try_cast("timestamp_ntz")
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a timestamp: "), text))) \
        .otherwise(parsed)


def lenient_timestamp(text: Column) -> Column:
    """Zone-free timestamp; text that is not one becomes null."""
    return text.try_cast("timestamp_ntz")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the table's types; further columns are dropped, a missing one is an error."""
    missing = [name for name in schema.fieldNames() if name not in df.columns and name not in DESCRIPTIVE]
    if missing:
        raise ValueError(f"the file has no column {', '.join(missing)}; it has {', '.join(df.columns)}")

    def convert(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            parse = strict_timestamp if field.name in STRICT_TIMES else lenient_timestamp
            return parse(text).alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            return text.cast("double").cast("int").alias(field.name)
        return text.cast(field.dataType).alias(field.name)

    return df.select(*[convert(field) for field in schema.fields])


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, as the file system of the path lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def _locate(spark: SparkSession, folder: str, name: str) -> str | None:
    """The one file of a table; several that could be meant are an error."""
    stem = FILE_STEMS.get(name, name)
    for pattern in [f"{name}.csv", *[p.format(stem) for p in FILE_PATTERNS]]:
        found = _matches(spark, f"{folder.rstrip('/')}/{pattern}")
        if len(found) > 1:
            raise ValueError(f"several files may be the table {name}: {', '.join(found)}; name one with files=")
        if found:
            return found[0]
    return None


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One CSV table as text columns by header name, then cast: the file's column order is free."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return typed(normalize_headers(raw), schema)


def load_star(spark: SparkSession, folder: str, files: dict[str, str] | None = None, check_keys: bool = True) -> Star:
    """Read the eight tables; one whose file is missing is logged and left empty.

    ``files`` maps table names to paths and overrides the search by name in ``folder``. Repeated keys are an error;
    ``check_keys=False`` saves the aggregation of every keyed table where they are known to be unique.
    """
    tables = {}
    for name, schema in STAR_SCHEMAS.items():
        path = (files or {}).get(name) or _locate(spark, folder, name)
        if path is None:
            log.warning("no file for table %s in %s", name, folder)
            tables[name] = spark.createDataFrame([], schema)
        else:
            tables[name] = read_csv_table(spark, path, schema)
    star = Star(**tables)
    if check_keys:
        star.require_unique_keys()
    return star


def save_star_csv(star: Star, folder: str) -> None:
    """Write every table as a folder of CSV part files with a header."""
    for name, df in star.tables().items():
        df.write.mode("overwrite").option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        ).csv(f"{folder}/{name}.csv")
