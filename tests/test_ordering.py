import random

import pytest
from pyspark.sql import functions as F

from shopgauge.functions.ordering import PART, lay_out, running, with_rank
from shopgauge.operators.customers import quantile_bin_ends, tile_ends


@pytest.fixture(scope="module")
def frame(spark):
    draw = random.Random(7)
    data = [(i, 5 if i % 3 == 0 else draw.randint(0, 50), "a" if i % 3 else "b") for i in range(3000)]
    return spark.createDataFrame(data, "id long, v long, g string"), data


def test_rank_equals_row_number(frame):
    df, data = frame
    got = {r.id: (r.rk, r.n) for r in with_rank(lay_out(df, ["v", "id"], parts=8)).collect()}
    want = {row[0]: (k + 1, len(data)) for k, row in enumerate(sorted(data, key=lambda x: (x[1], x[0])))}
    assert got == want


def test_rank_inside_groups_and_descending(frame):
    df, data = frame
    got = {r.id: r.rk for r in with_rank(lay_out(df, [F.desc("v"), F.col("id")], by=["g"], parts=8), ["g"]).collect()}
    for group in "ab":
        ordered = sorted((x for x in data if x[2] == group), key=lambda x: (-x[1], x[0]))
        assert [got[x[0]] for x in ordered] == list(range(1, len(ordered) + 1))


def test_a_value_of_a_third_of_all_rows_spreads_over_parts(frame):
    df, _ = frame
    laid = lay_out(df, ["v", "id"], parts=8)
    hot = laid.where("v = 5").select(PART).distinct().count()
    largest = laid.groupBy(PART).count().agg(F.max("count")).first()[0]
    assert hot >= 2
    assert largest < 3000 / 3


def test_running_sum_and_max_carry_over_parts(frame):
    df, data = frame
    for how, fold in ((F.sum, lambda acc, v: acc + v), (F.max, max)):
        laid = lay_out(df, ["id"], by=["g"], parts=8)
        got = {r.id: r.so_far for r in running(laid, ["g"], "so_far", F.col("v"), how).collect()}
        for group in "ab":
            acc = None
            for i, v, _ in sorted(x for x in data if x[2] == group):
                acc = v if acc is None else fold(acc, v)
                assert got[i] == acc


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 12, 23, 100])
def test_tile_and_bin_ends(n):
    """Against the definitions of ntile and of right-closed quantile bins of ranks."""
    q, r = divmod(n, 5)
    sizes = [q + 1 if t < r else q for t in range(5)]
    ntile = [t + 1 for t, size in enumerate(sizes) for _ in range(size)]
    assert [1 + sum(rk > end for end in tile_ends(n, 5)) for rk in range(1, n + 1)] == ntile
    bins = [max(1, -(-5 * (rk - 1) // (n - 1))) if n > 1 else 1 for rk in range(1, n + 1)]
    assert [1 + sum(rk > end for end in quantile_bin_ends(n, 5)) for rk in range(1, n + 1)] == bins


def test_parts_sized_at_run_time_keep_the_order(spark, frame):
    df, data = frame
    wanted = [x[0] for x in sorted(data, key=lambda x: (x[1], x[0]))]
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            ranked = with_rank(lay_out(df, ["v", "id"]))
            assert [r.id for r in ranked.orderBy("rk").collect()] == wanted
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
