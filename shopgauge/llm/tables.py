"""Reading the text tables, and small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: The characters that separate words in the contracts of these operators.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: The columns of the documents table.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


#: Rows of a join side, of a few numbers or a digest each, up to which it is broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table of small rows as a broadcast side if it has few rows, else as it is: the join is shuffled then."""
    return F.broadcast(written) if written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else written


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null. Words become one byte each, which are then counted."""
    dotted = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, ".")
    return (F.octet_length(dotted) - F.octet_length(F.replace(dotted, F.lit("."), F.lit("")))).cast("long")


def in_blocks(texts: Iterable[T], size_of, most: int) -> Iterator[list[T]]:
    """Consecutive items in lists of about ``most`` units; one larger item makes a list of its own."""
    block, total = [], 0
    for item in texts:
        size = size_of(item)
        if block and total + size > most:
            yield block
            block, total = [], 0
        block.append(item)
        total += size
    if block:
        yield block


def beside_text(rows: DataFrame, columns: Sequence[str], made: dict[str, pa.DataType], work: Callable[[list[str]], list[Sequence[Any]]],
                most: int, text: str = "text") -> DataFrame:
    """The given columns, as they are, and new ones that ``work`` makes of the texts (null: empty), block by block.

    Kept columns stay in Arrow: no id passes through a double, whatever nulls are beside it. ``made`` has the new columns'
    names and types, ``work`` returns their values in that order; a block has about ``most`` characters.
    """
    kept = rows.select(*columns).schema
    schema = pa.schema([pa.field(name, kind) for name, kind in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(columns)).to_pylist()]
            for block in in_blocks(range(len(texts)), lambda i: len(texts[i]) + 1, most):
                values = [pa.array(v, f.type) for v, f in zip(work([texts[i] for i in block]), schema)]
                part = batch.slice(block[0], len(block))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *values], names=[*columns, *schema.names])

    out = kept
    for name, kind in made.items():
        out = out.add(name, from_arrow_type(kind), True)
    return rows.select(*columns, F.col(text).alias("_read")).mapInArrow(run, out)
