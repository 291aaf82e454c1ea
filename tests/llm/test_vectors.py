"""Operators on vectors, against numpy and plain code."""

import hashlib
import random

import numpy as np
import pytest

import check
from shopgauge.llm import cover_codes, oracles, qd_whitening, queries, vectors

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def drawn(count, length, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(count, length)) * spread * np.linspace(1.5, 0.5, length)).astype(np.float32)


SPOILED = [(901, None, 1), (902, [], 1), (903, [0.1] * 11 + [None], 1), (904, [float("nan")] * 12, 1), (905, [float("inf")] * 12, 1), (906, [1.0] * 5, 1)]


@pytest.fixture(scope="module")
def table(spark):
    """300 vectors of 12 entries: repeated rows, null ids and labels, an id beyond 2**53, and rows that do not count."""
    x = drawn(297, 12)
    rows = [(i if i % 50 else None, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (9007199254740993, x[0].tolist(), 2)]
    random.Random(2).shuffle(rows)
    return rows, made(spark, rows + SPOILED)


def test_rows_that_count(spark, table):
    kept, length = vectors.usable(table[1], "embedding", "vec_id")
    assert (length, kept.count()) == (12, 300)
    assert vectors.usable(made(spark, []), "embedding", "vec_id")[1] == 0
    tied = made(spark, [(1, [0.0], 0), (2, [0.0, 1.0], 0)])
    assert vectors.usable(tied, "embedding", "vec_id")[1] == 2


def plain_components(x, count=8):
    n = len(x)
    whole = [[int(np.floor(1024 * float(c))) + 100000 for c in row] for row in x]
    sums = [sum(col) for col in zip(*whole)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in whole])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:count]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in whole]
    return deviations, centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_numpy(spark, table, parts):
    rows, df = table
    deviations, want, explained = plain_components(np.array([r[1] for r in rows], np.float32))
    got = qd_whitening.components(df.repartition(parts).withColumn("whitened", df["label"]).withColumn("at", df["label"]))
    assert got.columns[:4] == ["vec_id", "component", "n", "deviation"]
    found = {}
    for r in got.collect():
        found.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == 300 and r.identity_error < 1e-10
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    assert sum(map(len, found.values())) == 8 * len(rows)
    signs = {}
    for (vec_id, vector, _), deviation, values in zip(rows, deviations, want):
        for r in found[vec_id, deviation]:
            sign = signs.setdefault(r.component, 1 if r.whitened * values[r.component - 1] > 0 else -1)
            assert sign * r.whitened == pytest.approx(values[r.component - 1], abs=1e-9)


def test_whitening_without_variance_rank_or_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], SPOILED[:3], [(i, [0.25, 0.5], 0) for i in range(5)]):
        got = qd_whitening.components(made(spark, rows))
        assert got.columns == columns and got.isEmpty()
    line = [(i, [0.1 * i, 0.2 * i, -0.1 * i], 0) for i in range(1, 9)]
    got = qd_whitening.components(made(spark, line)).where("component = 1").collect()
    assert len(got) == 8 and got[0].explained > 0.999


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40], [-(1 << 40)]], np.int64)
    assert qd_whitening._deviations(x, 2, [0]) == [None, None]
    small = np.array([[3, 5], [4, 9]], np.int64)
    assert qd_whitening._deviations(small, 2, [7, 14]) == [1 + 16, 1 + 16]


@pytest.mark.parametrize("matrix", [
    drawn(90, 30, 3), np.repeat(drawn(20, 9, 4), 4, axis=0), np.eye(12), drawn(5, 11, 5), np.hstack([drawn(60, 4, 6)] * 3),
    drawn(80, 25, 7) * np.logspace(0, -7, 25), np.kron(np.eye(3), drawn(6, 4, 8)), drawn(4, 1, 9),
], ids=str)
def test_solver_keeps_small_values_accurate(matrix):
    a = matrix.astype(float)
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])
    d, e, v = qd_whitening.bidiagonal(r)
    b = np.diag(d) + np.diag(e, 1)
    assert np.abs(v @ v.T - np.eye(len(r))).max() < 1e-13
    assert np.abs(b.T @ b - v.T @ r.T @ r @ v).max() < 1e-12 * max(1, np.abs(r).max() ** 2)
    want = np.linalg.svd(b, compute_uv=False) ** 2
    assert qd_whitening.dqds(d, e) == pytest.approx(want, rel=1e-9, abs=1e-26 + 1e-28 * want[0])
    w = qd_whitening.solved(r, len(a), [0] * a.shape[1])
    assert np.abs(w.axes.T @ w.axes - np.eye(w.axes.shape[1])).max() < 1e-10
    assert np.abs(a.T @ a / len(a) @ w.axes - w.axes * w.variances).max() < 1e-12 * w.variances[0]


def test_values_of_graded_matrices_have_relative_accuracy():
    d, e = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1.0, 1e-5, 1e-9])
    b = [[d[i] if i == j else e[i] if j == i + 1 else 0.0 for j in range(4)] for i in range(4)]
    product = np.prod(np.sqrt(qd_whitening.dqds(d, e)))
    assert product == pytest.approx(abs(float(np.prod(d))), rel=1e-12)  # the determinant, which small errors would spoil
    assert np.sqrt(qd_whitening.dqds(d, e))[0] == pytest.approx(np.linalg.norm(np.array(b), 2), rel=1e-14)


def plain_codes(rows, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 12 and all(v is not None and np.isfinite(v) for v in r[1])]
    whole = [[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] + [0] * 4 for r in kept]
    parts = [[w[p : p + 1] for p in range(16)] for w in whole]
    least = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[parts[i][p] for i in least] for p in range(16)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            of = {}
            for one in parts:
                of.setdefault(nearest(one[p], books[p])[1], []).append(one[p])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else entry for k, entry in enumerate(books[p])]
    out = []
    for r, one in zip(kept, parts):
        found = [nearest(one[p], books[p]) for p in range(16)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted((str(i), code, error, sums[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("parts", [1, 6])
def test_codes_equal_plain_rounds(table, parts):
    rows, df = table
    got = cover_codes.compressed(df.repartition(parts).withColumn("error", df["label"]).withColumn("of", df["label"]))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    few = [(i, [float(i + j) / 8 for j in range(12)], None) for i in range(3)]
    got = cover_codes.compressed(made(spark, few)).collect()
    assert sorted(r.code for r in got) == [f"{i:02x}" * 12 + "00" * 4 for i in range(3)]
    assert all(r.error == 0 and r.label_error == 0 for r in got)
    assert cover_codes.compressed(made(spark, SPOILED[:3])).isEmpty()


@pytest.mark.parametrize("points", [
    np.random.default_rng(0).integers(-60, 60, (900, 4)), np.random.default_rng(1).integers(0, 3, (500, 2)), np.zeros((40, 4), int),
    np.array([[5, 5]]), np.repeat(np.random.default_rng(2).integers(0, 2000, (7, 3)), 90, axis=0),
], ids=["spread", "ties", "equal", "one", "copies"])
def test_cover_tree_covers_and_assigns_exactly(points):
    tree = cover_codes.cover_tree(points.astype(np.int32), leaf=3)
    assert sorted(tree.rows.tolist()) == list(range(len(points))) and (tree.points == points[tree.rows]).all()
    for node in range(len(tree.centre)):
        covered = tree.points[tree.first[node] : tree.end[node]]
        assert len(covered) and np.sqrt(((covered - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        children = range(tree.child[node], tree.child_end[node])
        stretches = [(tree.first[c], tree.end[c]) for c in children]
        if stretches:
            assert [a for a, _ in stretches] + [tree.end[node]] == [tree.first[node]] + [b for _, b in stretches]
    entries = np.concatenate([points[:20], points[:5], points[-3:] + 1])
    want = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    code, error = cover_codes.codes(tree, entries)
    assert (code == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()
    count, sums = cover_codes.entry_sums(tree, entries)
    assert (count == np.bincount(code, minlength=len(entries))).all()
    assert all((sums[k] == points[code == k].sum(axis=0)).all() for k in range(len(entries)))


def test_subtrees_far_from_other_entries_go_as_a_whole():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 9, (400, 4)), rng.integers(5000, 5009, (400, 4))])
    tree = cover_codes.cover_tree(points)
    stretches = sum(len(entry) for _, _, entry in cover_codes.assigned(tree, np.array([[4, 4, 4, 4], [5004, 5004, 5004, 5004]])))
    assert stretches <= 10


def test_code_query_equals_its_sql(spark):
    df = queries.vector_codes(spark, SF_DIR)
    assert check.differences(df, check.oracle_connection(SF_DIR), oracles.COVER_CODES) == ""
