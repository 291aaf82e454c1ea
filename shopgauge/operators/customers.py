"""Cohorts, retention, RFM segments and lifetime value of persons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopgauge.functions.columns import epoch_micros, mean_money, money, month_label, month_start, percent, whole_days
from shopgauge.functions.selection import at_ranks, id_order
from shopgauge.operators.facts import active_months, delivered, sales_by_person
from shopgauge.schema import PERSON
from shopgauge.session import materialize
from shopgauge.star import Star


def _cohort_counts(star: Star) -> DataFrame:
    """Active persons by cohort month and month offset.

    A person has each month once here, so counting rows counts persons.
    """
    months = active_months(star)
    first = months.groupBy(PERSON).agg(F.min("month").alias("cohort"))
    return (
        months.join(first, PERSON)
        .groupBy("cohort", (F.col("month") - F.col("cohort")).cast("bigint").alias("month_offset"))
        .agg(F.count(F.lit(1)).alias("active_customers"))
        .select(month_start("cohort").alias("cohort_month"), "month_offset", "active_customers")
    )


def month_sketches(star: Star, log_size: int = 14) -> DataFrame:
    """One mergeable distinct sketch of the active persons of each month.

    A stored row needs no rescan when other months come, or other persons of the same month: ``merged_months`` takes the
    union of any number of them.
    """
    sketch = F.theta_sketch_agg(F.col(PERSON), log_size)
    return active_months(star).groupBy(F.col("month").cast("bigint").alias("month")).agg(sketch.alias("sketch"))


def merged_months(sketches: DataFrame, log_size: int = 14) -> DataFrame:
    return sketches.groupBy("month").agg(F.theta_union_agg("sketch", log_size).alias("sketch"))


def cohorts_from_sketches(sketches: DataFrame, log_size: int = 14) -> DataFrame:
    """Active persons by cohort month and month offset out of stored sketches, each month of which may come in parts.

    A cohort is the sketch of its month without the union of all earlier ones; those active later are its intersection
    with a later month. Counts are exact while no more than 2 ** log_size persons have been seen. Beyond, a sketch samples
    persons at the rate of that number over all persons seen by its latest month, and a count has a relative standard error
    of 1 / sqrt(rate * count). Rows whose estimate is 0 are left out.

    The windows without partitions run over one row a month.
    """
    by_month = Window.orderBy("month")
    known = F.theta_union_agg("sketch", log_size).over(by_month.rowsBetween(Window.unboundedPreceding, -1))
    onwards = F.collect_list("month").over(by_month.rowsBetween(0, Window.unboundedFollowing))
    months = merged_months(sketches, log_size)
    cohorts = months.withColumn("known", known).withColumn("onwards", onwards).select(
        F.col("month").alias("cohort"), F.explode("onwards").alias("month"),
        F.when(F.col("known").isNull(), F.col("sketch")).otherwise(F.theta_difference("sketch", "known")).alias("members"),
    )
    count = F.theta_sketch_estimate(F.theta_intersection("members", "sketch")).cast("bigint")
    return (
        cohorts.join(months, "month")
        .select(month_start("cohort").alias("cohort_month"), (F.col("month") - F.col("cohort")).alias("month_offset"), count.alias("active_customers"))
        .where(F.col("active_customers") > 0)
    )


def _counts(source: Star | DataFrame) -> DataFrame:
    return source if isinstance(source, DataFrame) else _cohort_counts(source)


def cohort_retention_counts(source: Star | DataFrame) -> DataFrame:
    """Like the other cohort reports, of a star, or of counts that ``cohorts_from_sketches`` made."""
    return _counts(source).orderBy("cohort_month", "month_offset")


def cohort_window(source: Star | DataFrame, max_offset: int = 5, latest: int = 8) -> DataFrame:
    """Cohort counts up to ``max_offset`` for the latest cohorts that have such rows.

    The window without partitions runs over aggregated rows, a few per calendar month.
    """
    newest_first = Window.orderBy(F.desc("cohort_month"))
    return (
        _counts(source)
        .where(F.col("month_offset") <= max_offset)
        .withColumn("age", F.dense_rank().over(newest_first))
        .where(F.col("age") <= latest)
        .select(
            month_label("cohort_month").alias("cohort_month"), "month_offset",
            F.col("active_customers").alias("customers"),
        )
        .orderBy("cohort_month", "month_offset")
    )


def cohort_matrix(source: Star | DataFrame, max_offset: int = 5, latest: int = 8) -> DataFrame:
    """Retention in whole percent, one row per cohort and one column per offset; no activity is null."""

    def active(offset: int) -> Column:
        return F.max(F.when(F.col("month_offset") == offset, F.col("customers")))

    offsets = range(max_offset + 1)
    wide = cohort_window(source, max_offset, latest).groupBy("cohort_month").agg(
        *[active(offset).alias(f"c{offset}") for offset in offsets]
    )
    base = F.col("c0").cast("double")
    return wide.select(
        "cohort_month",
        *[F.floor(F.col(f"c{o}").cast("double") / base * 100 + 0.5).alias(f"m{o}") for o in offsets],
    ).orderBy("cohort_month")


def month_dropoff(source: Star | DataFrame, offset: int = 2) -> DataFrame:
    """Share of each cohort that is not active ``offset`` months after its first."""
    base = F.coalesce(F.max(F.when(F.col("month_offset") == 0, F.col("active_customers"))), F.lit(0))
    later = F.coalesce(F.max(F.when(F.col("month_offset") == offset, F.col("active_customers"))), F.lit(0))
    return (
        _counts(source)
        .groupBy("cohort_month")
        .agg(base.alias("cohort_size"), later.alias("still_active"))
        .withColumn("inactive_pct", percent(F.col("cohort_size") - F.col("still_active"), "cohort_size"))
        .orderBy("cohort_month")
    )


def repeat_purchase_rate(star: Star) -> DataFrame:
    people = star.customers.select("customer_id", PERSON)
    orders = (
        delivered(star).groupBy("customer_id").agg(F.count("order_id").alias("orders"))
        .join(people, "customer_id")
        .groupBy(PERSON)
        .agg(F.sum("orders").alias("orders"))
    )
    return orders.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
    ).withColumn("repeat_purchase_rate_pct", percent("repeat_customers", "total_customers"))


def monthly_retention(star: Star) -> DataFrame:
    """Persons active in a month and those active again in the next one."""
    months = active_months(star)
    again = months.select(PERSON, (F.col("month") - 1).alias("month"), F.lit(True).alias("returned"))
    return (
        months.join(again, [PERSON, "month"], "left")
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("active_count"), F.count("returned").alias("retained_count"))
        .select(
            month_start("month").alias("active_month"), "active_count", "retained_count",
            percent("retained_count", "active_count").alias("retention_rate_pct"),
        )
        .orderBy("active_month")
    )


def _at_ranks(people: DataFrame, metrics: dict[str, Column], ranks: list[int]) -> dict[str, dict[int, tuple]]:
    """Per metric, the (key, person) found at each of the given ranks of the order (key, person).

    Persons are counted in nested histograms, all metrics at once; none is shuffled or sorted. What comes back to the
    driver is bounded by the numbers of metrics and ranks.
    """
    by_person = id_order(people, PERSON)
    orders = {name: [key.cast("bigint"), *by_person] for name, key in metrics.items()}
    return at_ranks(people, orders, {name: ranks for name in metrics}, F.col(PERSON))


def _score(key: Column, cuts: list[tuple]) -> Column:
    """1 + the number of cut rows that a row lies beyond in the order (key, person)."""
    score = F.lit(1)
    for cut_key, cut_person in cuts:
        beyond = (key > cut_key) | ((key == cut_key) & (F.col(PERSON) > F.lit(cut_person)))
        score = score + beyond.cast("int")
    return score.cast("bigint")


def tile_ends(n: int, tiles: int) -> list[int]:
    """Ranks of the last row of all tiles but the last: sizes differ by one at most, larger tiles first."""
    size, larger = divmod(n, tiles)
    return [t * size + min(t, larger) for t in range(1, tiles)]


def quantile_bin_ends(n: int, bins: int) -> list[int]:
    """Ranks of the last row of all right-closed quantile bins of the ranks 1..n but the last bin."""
    return [t * (n - 1) // bins + 1 for t in range(1, bins)]


def global_scores(people: DataFrame, metrics: dict[str, Column], ends: Callable[[int, int], list[int]], k: int = 5) -> DataFrame:
    """Add one score (1..k) per metric to a written table of persons; ties are broken by the person's id."""
    n = people.count()
    if n == 0:
        return _unscored(people, list(metrics))
    cut_ranks = ends(n, k)
    found = _at_ranks(people, metrics, cut_ranks)
    return people.select(
        "*", *[_score(key, [found[name][r] for r in cut_ranks]).alias(name) for name, key in metrics.items()]
    )


def _unscored(people: DataFrame, names: list[str]) -> DataFrame:
    return people.select("*", *[F.lit(None).cast("bigint").alias(name) for name in names])


def _segment(champions: Column, loyal_label: str) -> Column:
    r, f = F.col("r_score"), F.col("f_score")
    return (
        F.when(champions, "Champions")
        .when((r >= 3) & (f >= 3), loyal_label)
        .when((r >= 4) & (f <= 2), "New Customers")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Needs Attention")
    )


def rfm_segments(star: Star) -> DataFrame:
    """Fifths by last purchase (latest first, so 1 is the most recent), frequency and spend, with segments.

    The direction of the recency score against its labels is part of the definition of this report;
    ``rfm_segment_counts`` has the other sense.
    """
    people = materialize(sales_by_person(star), "rfm")
    scored = global_scores(
        people,
        {
            "r_score": -epoch_micros("last_purchase"),
            "f_score": F.col("frequency"),
            "m_score": F.col("monetary_cents"),
        },
        tile_ends,
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        PERSON, "r_score", "f_score", "m_score", (r + f + m).alias("rfm_total"),
        _segment((r >= 4) & (f >= 4) & (m >= 4), "Loyal Customers").alias("segment"),
    ).orderBy(F.desc("rfm_total"), PERSON)


def _interpolation_spots(n: int, k: int) -> list[tuple[int, int, int]]:
    """For the edges 0..k of k quantile bins: rank below, rank above and the k-ths of the way between them."""
    spots = []
    for t in range(k + 1):
        low, rest = divmod(t * (n - 1), k)
        spots.append((low + 1, min(low + 2, n), rest))
    return spots


def _quantile_score(key: Column, found: dict[int, tuple], spots: list[tuple[int, int, int]], strict: bool) -> Column:
    """k..1 by the linearly interpolated quantiles of an integer key; a value on an edge is in the lower bin.

    All in integers: an edge between two neighbours is compared as ``k`` times its value. Equal edges leave
    bins empty; ``strict`` refuses them.
    """
    k = len(spots) - 1
    edges = []
    for low, high, rest in spots:
        lower, upper = found[low][0], found[high][0]
        edges.append(k * lower + (upper - lower) * rest)
    if strict and len(set(edges)) < len(edges):
        raise ValueError("quantile edges are not unique")
    score = F.lit(k)
    for edge in edges[1:-1]:
        score = score - (key * k > edge).cast("int")
    return score.cast("bigint")


def rfm_scores(star: Star, strict: bool = False, k: int = 5) -> DataFrame:
    """Per person: whole days since the last purchase, frequency, spend, and fifths where 5 is best."""
    sales = materialize(sales_by_person(star), "rfm")
    latest = sales.agg(F.max("last_purchase")).scalar()
    people = sales.select(
        PERSON, whole_days(latest, F.col("last_purchase")).alias("recency"), "frequency", "monetary_cents"
    )
    n = sales.count()
    if n == 0:
        return _unscored(people, ["f_score", "m_score", "r_score"])
    metrics = {"r_score": F.col("recency"), "f_score": F.col("frequency"), "m_score": F.col("monetary_cents")}
    cut_ranks, spots = quantile_bin_ends(n, k), _interpolation_spots(n, k)
    found = _at_ranks(people, metrics, cut_ranks + [rank for low, high, _ in spots for rank in (low, high)])

    def ranked(name: str) -> Column:
        return _score(metrics[name], [found[name][r] for r in cut_ranks]).alias(name)

    return people.select(
        "*", ranked("f_score"), ranked("m_score"),
        _quantile_score(F.col("recency"), found["r_score"], spots, strict).alias("r_score"),
    )


def rfm_segment_counts(star: Star, strict: bool = False) -> DataFrame:
    """Persons per segment; recent and frequent buyers are Champions whatever they spend."""
    champions = (F.col("r_score") >= 4) & (F.col("f_score") >= 4)
    return (
        rfm_scores(star, strict)
        .groupBy(_segment(champions, "Loyal").alias("segment"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "segment")
    )


def clv_distribution(star: Star) -> DataFrame:
    """Count, mean, exact median, extremes and sample deviation of delivered revenue per person."""
    people = materialize(sales_by_person(star).select(F.col("monetary_cents").alias("cents")), "clv")
    n = people.count()
    middle = [(n + 1) // 2, n // 2 + 1] if n else []
    found = at_ranks(people, {"cents": [F.col("cents")]}, {"cents": middle}, F.col("cents"))["cents"]
    median = mean_money(F.lit(sum(found[rank][0] for rank in middle)), F.lit(2)) if n else F.lit(None).cast("double")
    return people.agg(*_clv_sums(), median.alias("median_clv")).select(*CLV_FIELDS)


# Fields of the distribution, in order.
CLV_FIELDS = ["total_customers", "avg_clv", "median_clv", "min_clv", "max_clv", "stddev_clv"]


def _clv_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_customers"),
        mean_money(F.sum("cents"), F.count("cents")).alias("avg_clv"),
        money(F.min("cents")).alias("min_clv"),
        money(F.max("cents")).alias("max_clv"),
        F.round(F.stddev_samp(money("cents")), 2).alias("stddev_clv"),
    ]


def clv_sketches(star: Star, k: int = 800) -> DataFrame:
    """One mergeable quantile sketch of revenue per person for each month of first purchase, with exact sums beside it.

    A stored row needs no rescan when other months come: ``clv_from_sketches`` merges any of them.
    """
    people = sales_by_person(star).select(F.col("monetary_cents").alias("cents"), PERSON)
    first = active_months(star).groupBy(PERSON).agg(F.min("month").alias("cohort"))
    spend = money("cents")
    return people.join(first, PERSON).groupBy(month_start("cohort").alias("cohort_month")).agg(
        F.expr(f"kll_sketch_agg_bigint(cents, {k})").alias("sketch"),
        F.count(F.lit(1)).alias("persons"), F.sum("cents").alias("cents"), F.min("cents").alias("least"), F.max("cents").alias("most"),
        F.sum(spend * spend).alias("squares"),
    )


def clv_from_sketches(sketches: DataFrame) -> DataFrame:
    """The distribution out of stored sketches; the median is approximate, all else is exact (the deviation to rounding).

    The rank of the answer is off by a share of the persons that falls with the sketch's k: about 0.3 % at 800.
    """
    merged = sketches.agg(
        F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"), F.sum("persons").alias("n"), F.sum("cents").alias("cents"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("squares").alias("squares"),
    )
    n, total = F.col("n").cast("double"), money("cents")
    return merged.select(
        F.col("n").alias("total_customers"), mean_money("cents", "n").alias("avg_clv"),
        money(F.expr("kll_sketch_get_quantile_bigint(sketch, 0.5D)")).alias("median_clv"),
        money("least").alias("min_clv"), money("most").alias("max_clv"),
        F.round(F.sqrt(F.try_divide(F.col("squares") - total * total / n, n - 1)), 2).alias("stddev_clv"),
    )
