"""Whitening against exact fractions and numpy, and defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gristmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], schema).repartition(parts)


def plain(vectors):
    """n, exact deviations, exact covariance (as doubles), centred values."""
    d = max(map(len, vectors))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = [[Fraction(n * c - s, n) for c, s in zip(v, sums)] for v in x]
    covariance = np.array([[float(sum(v[a] * v[b] for v in centred) / n) for b in range(d)] for a in range(d)])
    return n, deviation, covariance, np.array([[float(c) for c in v] for v in centred])


def check(got, rows, k):
    vectors = [np.float32(v).astype(float).tolist() for _, v in rows]
    n, deviation, covariance, centred = plain(vectors)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-9)
    for (i, _), own, c in zip(rows, deviation, centred):
        mine = by[i, own]
        assert sorted(mine) == list(range(1, k + 1))
        for j in range(k):
            assert abs(mine[j + 1]["whitened"]) == pytest.approx(abs(c @ axes[:, j]) / math.sqrt(values[j]), rel=1e-6, abs=1e-8)
    for j in range(1, k + 1):
        signs = {np.sign(by[i, own][j]["whitened"] * (c @ axes[:, j - 1])) for (i, _), own, c in zip(rows, deviation, centred) if abs(c @ axes[:, j - 1]) > 1e-6}
        assert len(signs) == 1


@pytest.mark.parametrize("n, d", [(60, 5), (150, 40)])
def test_matches_exact_fractions(spark, n, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(n, d)) * np.exp(rng.normal(size=d)) + 3 * rng.normal(size=d)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    check(whitening.whitened(table(spark, rows)).collect(), rows, min(d, 32))


def test_odd_rows_are_dropped_and_short_ones_padded(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, [-1.0, 0.25, 3.0]), (2, [-1.0, 0.25, 3.0]), (3, [4.0]), (4, [0.5, -2.0]), (None, [2.0, 2.0, -7.0])]
    odd = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [float("nan")] * 3), (14, [float("inf"), 0.0, 0.0]), (15, [1e17, 0.0, 0.0])]
    got = whitening.whitened(table(spark, rows + odd)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4, None} and sum(r["vec_id"] == 2 for r in got) == 6
    distinct = [r for k, r in enumerate(rows) if k != 2]
    n, deviation, covariance, _ = plain([v for _, v in rows])
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, own) for (i, _), own in zip(rows, deviation)}
    assert len({(r["vec_id"], r["component"]) for r in got}) == 3 * len(distinct)
    assert {r["explained"] for r in got if r["component"] == 1}.pop() == pytest.approx(np.linalg.eigvalsh(covariance)[-1] / np.trace(covariance), rel=1e-9)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(1 << 50) * (1 + k % 7), float(1 << 20) * k]) for k in range(40)]
    got = whitening.whitened(table(spark, rows)).collect()
    _, deviation, covariance, _ = plain([v for _, v in rows])
    assert all(r["deviation"] == (own if own < 1 << 63 else None) for r in got for own in [deviation[r["vec_id"]]])
    values = np.linalg.eigvalsh(covariance)[::-1]
    assert {r["explained"] for r in got if r["component"] == 1}.pop() == pytest.approx(values[0] / values.sum(), rel=1e-9)
    # The sums of tasks don't depend on how rows are dealt to them.
    one = whitening.Whitening(table(spark, rows, parts=1))
    assert (one.covariance == whitening.Whitening(table(spark, rows, parts=7)).covariance).all()


def test_polarised_covariance_equals_the_direct_one(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(80, 12)).astype(np.float32))]
    assert (whitening.Whitening(table(spark, rows)).covariance == plain([v for _, v in rows])[2]).all()


def test_without_variance(spark):
    got = whitening.whitened(table(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect()
    assert len(got) == 10 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    # One direction varies, the other doesn't.
    got = whitening.whitened(table(spark, [(k, [float(k), float(k)]) for k in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in got)


def test_no_vectors(spark):
    for rows in ([(1, [1.0])], [(-1, None)]):
        out = whitening.whitened(table(spark, rows).where("vec_id < 0"))
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
