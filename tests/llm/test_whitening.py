"""Whitening against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, dims string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((40, 40)) * np.linspace(0.05, 3, 40) + 4
    x = np.float32(rng.standard_normal((700, 40)) @ mixed / 6 + 50)
    x[100:330] = x[100]  # a third are copies
    out = [(i if i % 3 else None, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [], [1.0, None] + [0.0] * 38, [float("nan")] * 40, [float("inf")] + [0.0] * 39]
    return out + [(1000 + i, v) for i, v in enumerate(bad)]


def brute(rows, wanted=32, dims=40):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], object)
    cov = ((off.T @ off) / n**3).astype(float)
    e, p = np.linalg.eigh(cov)
    return kept, n, (off**2).sum(axis=1), (off / n).astype(float), cov, e[::-1][:wanted], p[:, ::-1][:, :wanted]


def test_whitening(spark, rows):
    got = whitening.whiten(table(spark, rows).repartition(3)).collect()
    kept, n, deviation, off, cov, e, p = brute(rows)
    assert len(got) == len(kept) * 32 and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    want = off @ p / np.sqrt(e)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = None
    for (i, _), d, w in zip(kept, deviation, want):
        mine = by[i, d]
        assert sorted(mine) == list(range(1, 33))
        values = np.array([mine[c][0]["whitened"] for c in range(1, 33)])
        signs = np.sign(values * w) if signs is None else signs
        np.testing.assert_allclose(values, signs * w, atol=1e-8)
        np.testing.assert_allclose([mine[c][0]["explained"] for c in range(1, 33)], e / np.trace(cov), rtol=1e-9)


def test_components_need_variance_lengths_and_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 3.0]), (4, [5.0]), (5, []), (6, [5.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, rows)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (6, 1)]
    assert got[1, 1]["n"] == 3 and got[4, 1]["n"] == 2
    assert abs(abs(got[1, 1]["whitened"]) - math.sqrt(2)) < 1e-12 and got[1, 1]["explained"] == pytest.approx(1)
    assert got[1, 2]["whitened"] is None and got[1, 2]["explained"] == 0
    assert got[4, 1]["whitened"] is None and got[4, 1]["explained"] is None and got[4, 1]["deviation"] == 0
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["whitened"], r["identity_error"]) for r in one] == [(None, None)] * 2


def test_large_entries_are_exact(spark):
    rows = [(i, [1e9 * (i % 7), -3e8 * i, float(i)]) for i in range(9)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table(spark, rows)).where("component = 1").collect()}
    exact = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    _, _, deviation, *_ = brute(exact, 3, 3)
    assert got == dict(zip(range(9), deviation))


def test_inertia_and_contours():
    rng = np.random.default_rng(2)
    for values in ([1.0] * 6 + [2.0] * 5 + [5.0], list(range(1, 31)), [1e-9, 1.0, 1.0 + 1e-12, 3.0], [7.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        m = q @ np.diag(values) @ q.T
        m = (m + m.T) / 2
        tri = whitening.tridiagonal(m)
        shifts = np.array([0.5, 1.5, 2.5, 6.0])
        assert whitening.inertia(tri, shifts).tolist() == [sum(v < s for v in values) for s in shifts]
        circles = whitening.contours(m, 4)
        assert sum(c for *_, c in circles) >= min(4, len(values)) - (values[0] < 1e-6)
        found = []
        for low, high, count in circles:
            e, v = whitening.feast(m, low, high, count)
            assert len(e) == count and np.abs(m @ v - v * e).max() < 1e-11
            found += e.tolist()
        np.testing.assert_allclose(sorted(found), sorted(values)[-len(found) :], atol=1e-10)


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([1.0, 2.0, 9.0, 10.0]), 0.5, 2.5, 3)


def test_extra_columns(spark):
    df = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]).withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    assert whitening.whiten(df).count() == 4
