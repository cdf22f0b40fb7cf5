"""Whitening against numpy on whole tables."""

import math

import numpy as np
import pytest

from merchlake.llm import op12_whitening as op
from merchlake.llm.queries import op12_whitening

SF = "/root/testdata/sf0.01"


def exact(vectors):
    """Whole numbers, their sums, eigenvalues and eigenvectors (falling) from the full covariance."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    centred = np.array([[(n * r[i] - sums[i]) / n for i in range(dims)] for r in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    squares = [sum((n * r[i] - sums[i]) ** 2 for i in range(dims)) for r in x]
    return n, squares, centred, values[::-1], basis[:, ::-1]


def check(rows, ids, vectors, most=8):
    n, squares, centred, values, basis = exact(vectors)
    k = min(most, int((values > len(values) * 2.3e-16 * values[0]).sum()))
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(by) == n * k
    for j in range(k):
        want = centred @ basis[:, j] / math.sqrt(values[j])
        got = np.array([by[i, j + 1]["whitened"] for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert all(abs(by[i, j + 1]["explained"] - values[j] / values.sum()) < 1e-12 for i in ids)
    assert all(by[i, 1]["deviation"] == s and int(by[i, 1]["deviation_wide"]) == s for i, s in zip(ids, squares, strict=True))
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def table(spark, vectors, extra=""):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *([extra] if extra else []))


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(op12_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def steep(n=300, dims=40, seed=5):
    r = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(r.standard_normal((dims, dims)))
    return ((r.standard_normal((n, dims)) * 10.0 ** -np.arange(dims).clip(max=12)) @ turn.T * 100).tolist()


def test_few_directions_do_where_the_spectrum_falls(spark):
    """A steep spectrum is exact within the first directions; a flat one takes as many as there are dimensions."""
    v = steep()
    rows = op.whole_numbers(table(spark, v))
    n, sums = op._totals(rows)
    values, vectors, trace, taken = op.components(rows, n, sums, most=3)
    assert max(taken) == 13 < 40
    _, _, _, want, basis = exact(v)
    assert np.allclose(values, want[:3], rtol=1e-12) and np.allclose(np.abs((vectors * basis[:, :3]).sum(0)), 1, atol=1e-12)
    assert abs(trace - want.sum()) < 1e-9 * trace
    flat = np.random.default_rng(1).standard_normal((200, 40)).tolist()
    rows = op.whole_numbers(table(spark, flat))
    n, sums = op._totals(rows)
    *_, taken = op.components(rows, n, sums, most=3)
    assert taken[0] == 13 and taken[-1] == 40
    check(op.whiten(table(spark, flat)).collect(), range(200), flat)


def test_rows_that_take_no_part(spark):
    good = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 2.0, 2.0], [-1.0, 0.0, 0.125]]
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 0.0, 0.0], [1.0, float("inf"), 0.0], [1.0, -float("inf"), 0.0], [1.0, 2.0], [0.0] * 5]
    rows = [(i, v) for i, v in enumerate(good + bad)] + [(1, good[1]), (None, good[2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' as x", "1 as n", "2 as component", "vec_id as v")
    got = op.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got if r["component"] == 1) == ["0", "1", "1", "2", "3", "None"]
    assert {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {6}
    assert got[0]["identity_error"] < 1e-9


def test_rows_that_do_not_vary(spark):
    assert op.whiten(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    assert op.whiten(table(spark, [[1.0, 2.0]])).collect() == []
    assert op.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    line = [[float(i), 2.0 * i, 3.0] for i in range(20)]
    got = op.whiten(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    assert sorted(r["whitened"] ** 2 for r in got)[-1] == pytest.approx((9.5**2) / np.var(range(20)))


def test_copies_of_one_vector_in_great_number(spark):
    some = np.random.default_rng(3).standard_normal((60, 12)).tolist()
    v = some + [some[0]] * 400
    check(op.whiten(table(spark, v)).collect(), range(len(v)), v)


def test_deviation_beyond_a_long_is_null_and_wide(spark):
    v = [[1e9, 0.0], [-1e9, 1.0], [5e8, 2.0]] * 3
    n, squares, *_ = exact(v)
    got = {r["vec_id"]: r for r in op.whiten(table(spark, v)).collect() if r["component"] == 1}
    assert max(squares) > 2**63
    for i, s in enumerate(squares):
        assert int(got[i]["deviation_wide"]) == s and got[i]["deviation"] == (s if s < 2**63 else None)
