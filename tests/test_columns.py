import pytest
from pyspark.sql import functions as F

from shopgauge.functions import columns as c


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "num, den, want", [(5, 2, 3), (-5, 2, -3), (4, 2, 2), (1, 3, 0), (2, 3, 1), (7, 0, None), (None, 3, None)]
)
def test_half_up(spark, num, den, want):
    assert value(spark, c.half_up(F.lit(num).cast("bigint"), F.lit(den).cast("bigint"))) == want


def test_half_cent_mean_rounds_up(spark):
    assert value(spark, c.mean_money(F.lit(1001), F.lit(2))) == 5.01


def test_percent_does_not_overflow(spark):
    assert value(spark, c.percent(F.lit(3 * 10**18), F.lit(9 * 10**18))) == 33.33


@pytest.mark.parametrize("x, digits, want", [(4.125, 2, 4.12), (4.135, 2, 4.14), (2.5, 0, 2.0), (-0.125, 2, -0.12)])
def test_array_round_is_half_even(spark, x, digits, want):
    assert value(spark, c.array_round(F.lit(x), digits)) == pytest.approx(want, abs=1e-12)


def test_cents_are_exact(spark):
    assert value(spark, c.cents(F.lit(0.29))) == 29
    assert value(spark, c.cents(F.lit(1234567.89))) == 123456789
    assert value(spark, c.cents(F.lit("90071992547.41").cast("decimal(18,2)"))) == 9007199254741
    assert value(spark, c.cents(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("amount", [0.004, 1234567.891, -0.125])
def test_parts_of_a_cent_are_refused(spark, amount):
    with pytest.raises(Exception, match="part of a cent"):
        value(spark, c.cents(F.lit(amount)))


@pytest.mark.parametrize(
    "later, earlier, days",
    [
        ("2024-01-03 01:00:00", "2024-01-01 23:00:00", 1),
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00", 0),
        ("2024-01-02 23:00:00", "2024-01-01 23:00:00", 1),
        ("2024-01-01 22:00:00", "2024-01-01 23:00:00", -1),
    ],
)
def test_whole_days_are_floored(spark, later, earlier, days):
    a, b = (F.lit(t).cast("timestamp_ntz") for t in (later, earlier))
    assert value(spark, c.whole_days(a, b)) == days


def test_day_spans_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-04-01 00:00:00", "2024-03-31 00:00:00"))
        assert value(spark, c.whole_days(a, b)) == 1
        assert value(spark, c.elapsed_seconds(a, b)) == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_elapsed_fraction(spark):
    a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02 00:00:00.25", "2024-01-01 23:59:59.75"))
    micros = c.elapsed_seconds(a, b) * 1000000 + c.elapsed_fraction(a, b)
    assert value(spark, micros) == 500000
    assert value(spark, c.epoch_micros(F.lit("1970-01-01 00:00:01.5").cast("timestamp_ntz"))) == 1500000


def test_month_numbers(spark):
    a, b = F.lit("2023-11-09").cast("date"), F.lit("2024-02-29 23:00:00").cast("timestamp_ntz")
    assert value(spark, c.month_number(b) - c.month_number(a)) == 3
    for text in ("2023-12-01", "2024-01-01", "2024-07-01"):
        assert str(value(spark, c.month_start(c.month_number(F.lit(text).cast("date"))))) == text
