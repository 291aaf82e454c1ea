"""Values at given ranks of an order, without sorting: nested histograms.

An order is a list of whole-number columns, the first one deciding. One pass counts rows in buckets of its range; only the
buckets that hold a wanted rank are looked at again, with the range of the values found there, until a bucket has few
rows, which are fetched, or a single value, where the next column of the order takes over. All orders and ranks share
the passes. A pass is a scan and a count by bucket: no row is shuffled, and a value that a third of all rows have is one
bucket. What comes to the driver is bounded by the numbers of orders, ranks and buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of a range; a bucket of at most so many rows is fetched.
BUCKETS, FETCHED = 1024, 512
_TEXT_BYTES = 6


def text_order(text: Column | str, longest: int) -> list[Column]:
    """The order of texts by their bytes, as whole numbers of six bytes each; texts of at most ``longest`` bytes."""
    data = (F.col(text) if isinstance(text, str) else text).cast("binary")
    pieces = range(0, max(longest, 1), _TEXT_BYTES)
    digits = [F.rpad(F.hex(F.substring(data, at + 1, _TEXT_BYTES)), 2 * _TEXT_BYTES, "0") for at in pieces]
    return [F.conv(d, 16, 10).cast("bigint") for d in digits]


def long_order(number: Column | str) -> list[Column]:
    """The order of longs in two halves: doubles, in which buckets are found, do not hold all longs."""
    value = F.col(number) if isinstance(number, str) else number
    return [F.shiftright(value, 32), value.bitwiseAND(F.lit((1 << 32) - 1))]


def id_order(rows: DataFrame, name: str) -> list[Column]:
    """The order of an id column, a text or a whole number."""
    if dict(rows.dtypes)[name] != "string":
        return long_order(F.col(name).cast("bigint"))
    return text_order(name, rows.agg(F.max(F.octet_length(name))).first()[0] or 0)


@dataclass
class _Bucket:
    """Rows of one order with ``same`` leading values and the next one in low..high; ``before`` rows come earlier."""

    name: str
    same: tuple[int, ...]
    low: int
    high: int
    before: int
    rows: int
    ranks: list[int]


def _inside(bucket: _Bucket, digits: Sequence[Column]) -> Column:
    at = digits[len(bucket.same)]
    match = (at >= F.lit(bucket.low)) & (at <= F.lit(bucket.high))
    for digit, value in zip(digits, bucket.same):
        match = match & (digit == F.lit(value))
    return match


def _number(bucket: _Bucket, digit: Column) -> Column:
    """Place of a value among the buckets of its range: rising with the value, 0 at the lowest, the last at the highest."""
    span = float(bucket.high - bucket.low) or 1.0
    share = (digit - F.lit(bucket.low)).cast("double") * (BUCKETS / span)
    return F.least(F.floor(share), F.lit(BUCKETS - 1)).cast("int")


def at_ranks(rows: DataFrame, orders: dict[str, Sequence[Column]], ranks: dict[str, Sequence[int]], value: Column) -> dict[str, dict[int, tuple]]:
    """By order and rank (1 is the first): the leading whole number there and ``value`` of that row.

    ``rows`` is read once for each round. Ranks must be within 1 and the number of rows, and no column of an order null.
    Rows equal in the whole order share their ranks: the one with the smallest ``value`` stands for them.
    """
    widths = {name: len(digits) for name, digits in orders.items()}
    flat = rows.select(value.alias("value"), *[d.cast("bigint").alias(f"{n}_{i}") for n, ds in orders.items() for i, d in enumerate(ds)])
    columns = {name: [F.col(f"{name}_{i}") for i in range(width)] for name, width in widths.items()}
    found: dict[str, dict[int, tuple]] = {name: {} for name in orders}
    names = [f"{name}_{i}" for name, width in widths.items() for i in range(width)]
    ends = flat.agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"min_{c}") for c in names], *[F.max(c).alias(f"max_{c}") for c in names]
    ).first()
    limits = {name: [(ends[f"min_{name}_{i}"], ends[f"max_{name}_{i}"]) for i in range(width)] for name, width in widths.items()}
    wide = [_Bucket(n, (), *limits[n][0], 0, ends.n, sorted(set(ranks[n]))) for n in orders if ranks[n] and ends.n]
    narrow: list[_Bucket] = []
    while wide:
        entries = F.array(*[
            F.when(_inside(b, columns[b.name]), F.struct(
                F.lit(i).alias("bucket"), _number(b, columns[b.name][len(b.same)]).alias("at"), columns[b.name][len(b.same)].alias("digit")))
            for i, b in enumerate(wide)
        ])
        counts = flat.select(F.inline(F.filter(entries, lambda e: e.isNotNull()))).groupBy("bucket", "at").agg(
            F.count(F.lit(1)).alias("n"), F.min("digit").alias("low"), F.max("digit").alias("high")
        ).collect()
        found_in: dict[int, list] = {}
        for row in sorted(counts, key=lambda r: (r["bucket"], r["at"])):
            found_in.setdefault(row["bucket"], []).append(row)
        following: list[_Bucket] = []
        for i, b in enumerate(wide):
            before = b.before
            for row in found_in[i]:
                inside = [r for r in b.ranks if before < r <= before + row["n"]]
                if inside:
                    part = _Bucket(b.name, b.same, row["low"], row["high"], before, row["n"], inside)
                    if part.low == part.high and len(part.same) + 1 < widths[b.name] and part.rows > FETCHED:
                        part = _Bucket(b.name, (*b.same, part.low), *limits[b.name][len(b.same) + 1], before, row["n"], inside)
                        following.append(part)
                    elif part.low == part.high or part.rows <= FETCHED:
                        narrow.append(part)
                    else:
                        following.append(part)
                before += row["n"]
        wide = following
    _fetch(flat, columns, narrow, found)
    return found


def _fetch(flat: DataFrame, columns: dict[str, list[Column]], buckets: list[_Bucket], found: dict[str, dict[int, tuple]]) -> None:
    """Ranks inside the last buckets: their few distinct rows are ordered here."""
    if not buckets:
        return
    entries = F.array(*[
        F.when(_inside(b, columns[b.name]), F.struct(F.lit(i).alias("bucket"), F.array(*columns[b.name]).alias("digits"), F.col("value").alias("value")))
        for i, b in enumerate(buckets)
    ])
    each = flat.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))
    rows = each.groupBy("bucket", "digits").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).orderBy("bucket", "digits").collect()
    passed = {i: b.before for i, b in enumerate(buckets)}
    for row in rows:
        b = buckets[row["bucket"]]
        upto = passed[row["bucket"]] + row["n"]
        for rank in b.ranks:
            if passed[row["bucket"]] < rank <= upto:
                found[b.name][rank] = (row["digits"][0], row["value"])
        passed[row["bucket"]] = upto
