"""Column helpers: exact money, rounding, months and day spans.

Money is summed as whole cents in BIGINT, so a sum does not depend on the order in which tasks finish and stays
inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: Column | str) -> Column:
    """Whole cents of an amount; an amount with a part of a cent is an error, as sums of rounded parts would be wrong.

    What a double may miss of a whole cent is allowed for: a millionth of a cent and a few of the amount's last bits.
    """
    scaled = _col(amount).cast("double") * 100
    whole = F.rint(scaled)
    broken = F.abs(scaled - whole) > F.lit(1e-6) + F.abs(scaled) * F.lit(1e-15)
    message = F.concat(F.lit("an amount has a part of a cent: "), _col(amount).cast("string"))
    return F.when(broken, F.raise_error(message).cast("bigint")).otherwise(whole.cast("bigint"))


def money(cent_count: Column | str) -> Column:
    return _col(cent_count).cast("double") / F.lit(100.0)


def wide(value: Column | str) -> Column:
    """An integer wide enough to be scaled without overflow; for aggregated rows."""
    return _col(value).cast("decimal(30,0)")


def half_up(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` to the nearest integer, halves away from zero; null over zero.

    Both are integers and the denominator is not negative, so nothing is lost to binary fractions.
    """
    n, d = wide(numerator), wide(denominator)
    magnitude = F.call_function("div", F.abs(n) * 2 + d, d * 2)
    return F.when((d != 0) & (n < 0), -magnitude).when(d != 0, magnitude)


def mean_money(cent_sum: Column | str, count: Column | str) -> Column:
    """Mean amount, rounded to the cent."""
    return money(half_up(cent_sum, count))


def percent(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100`` with two decimals."""
    return half_up(wide(part) * 10000, whole).cast("double") / F.lit(100.0)


def array_round(value: Column | str, digits: int) -> Column:
    """Rounding of the array libraries: scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(_col(value) * scale) / scale


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives null over zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def month(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "MM")


def month_label(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def month_number(ts: Column | str) -> Column:
    """Months since year 0."""
    day = _col(ts).cast("date")
    return F.year(day) * 12 + F.month(day) - 1


def month_start(number: Column | str) -> Column:
    """First day of a month given by ``month_number``."""
    n = _col(number)
    return F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)).cast("int") + 1, F.lit(1))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed days, floored: calendar days, less one if the last day is not complete."""
    a, b = _col(later), _col(earlier)
    calendar = F.date_diff(a, b)
    incomplete = (b + F.make_dt_interval(calendar)) > a
    return (calendar - incomplete.cast("int")).cast("bigint")


def seconds_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")


def micros_of_second(ts: Column) -> Column:
    return F.pmod((F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint"), F.lit(1000000))


def elapsed_seconds(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed time of two zone-free timestamps in seconds, without the difference of their fractions."""
    a, b = _col(later), _col(earlier)
    return F.date_diff(a, b).cast("bigint") * 86400 + seconds_of_day(a) - seconds_of_day(b)


def elapsed_fraction(later: Column | str, earlier: Column | str) -> Column:
    """What ``elapsed_seconds`` leaves out, in microseconds (may be negative)."""
    return micros_of_second(_col(later)) - micros_of_second(_col(earlier))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return elapsed_seconds(ts, start) * 1000000 + elapsed_fraction(ts, start)
