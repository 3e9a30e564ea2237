"""Strips and ranges of nearest-neighbour information: equal to all pairs on heaps, tails and copies, and few rows shuffled."""

import numpy as np
import pytest

from tidemark.operators import information
from tidemark.operators.distribution import digamma


def made():
    rng = np.random.default_rng(9)
    n = 900
    y = rng.normal(0, 1, n)
    return {
        "heaps": (rng.integers(0, 4, n) + rng.normal(0, 1e-10, n), y), "tails": (rng.standard_cauchy(n), rng.standard_cauchy(n)), "plain": (rng.random(n), y),
        "copies": (np.tile(rng.integers(0, 5, n // 9), 9) + rng.normal(0, 1e-10, n), np.tile(y[: n // 9], 9) + rng.normal(0, 1e-10, n)), "two": (np.array([0.0, 1.0]), np.array([0.0, 3.0])),
    }


@pytest.mark.parametrize("rows", [60, 10_000])
def test_distances_and_counts_against_all_pairs(spark, rows):
    sets = made()
    df = spark.createDataFrame([(f, i, len(x), float(a), float(b)) for f, (x, y) in sets.items() for i, (a, b) in enumerate(zip(x, y, strict=True))], "feature string, id long, n long, x double, y double")
    found = information.neighbour_distances(df, 3, rows)
    got, psi = {}, {a: {r.feature: r.p for r in information.mean_psi(found, a, rows).collect()} for a in "xy"}
    for r in found.collect():
        got.setdefault(r.feature, {})[r.id] = r.distance
    for f in ("heaps", "tails", "plain", "copies"):
        x, y = sets[f]
        far = np.maximum(np.abs(np.subtract.outer(x, x)), np.abs(np.subtract.outer(y, y)))
        np.fill_diagonal(far, np.inf)
        eps = np.sort(far, axis=1)[:, 2]
        np.testing.assert_array_equal([got[f][i] for i in range(len(x))], eps)
        inside = eps * (1 - 1e-9)
        for a, v in (("x", x), ("y", y)):
            n = ((v[None] >= (v - inside)[:, None]) & (v[None] <= (v + inside)[:, None])).sum(1)
            assert psi[a][f] == pytest.approx(digamma(n.astype(float)).mean(), abs=1e-12), (f, a)
    assert "two" not in got


def test_no_more_rows_are_written_than_points_and_a_few_that_ask(spark, monkeypatch):
    rng, n, sizes = np.random.default_rng(10), 4000, []
    df = spark.createDataFrame([("f", i, n, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 9, n) + rng.normal(0, 1e-10, n), rng.random(n), strict=True))], "feature string, id long, n long, x double, y double")
    kept = information.written

    def counting(frame):
        out = kept(frame)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(information, "written", counting)
    found = information.neighbour_distances(df, 3, 500)
    information.mean_psi(found, "x", 500).collect()
    assert found.count() == n and n <= sum(sizes) < 1.6 * n
