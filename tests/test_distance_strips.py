"""Distance correlation over strips of distinct points against all distances."""

import numpy as np

from tidemark.operators import statistics


def plain(xs, ys):
    a, b = ((d := np.abs(v[:, None] - v[None, :])) - d.mean(0) - d.mean(1)[:, None] + d.mean() for v in (xs, ys))
    return np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean()))


def test_products_below_against_all_pairs():
    rng = np.random.default_rng(2)
    place, x, y, w = rng.integers(0, 9, 70), rng.integers(0, 20, 70) * 1.0, rng.integers(0, 20, 70) * 1.0, rng.integers(1, 5, 70) * 1.0
    want = [sum(w[j] * (x[i] - x[j]) * (y[i] - y[j]) for j in range(70) if place[j] < place[i] and y[j] < y[i]) for i in range(70)]
    assert np.allclose(statistics._products_below(place, x, y, w), want)


def test_distance_correlation_of_many_strips(spark):
    """Few rows a strip, strips of one value, and rows that repeat: each distinct point is shuffled once a step, whatever its weight."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    groups = {"free": (x, x**2 + rng.normal(size=400)), "steps": (np.round(rng.exponential(size=400)), rng.normal(size=400)), "few": (rng.integers(0, 3, 400) * 1.0, rng.integers(0, 2, 400) * 1.0)}
    rows = [(g, float(a), float(b)) for g, (xs, ys) in groups.items() for a, b in zip(xs, ys, strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    for few in (1, 10, 1000):
        got = {r["g"]: r["dcor"] for r in statistics.distance_correlation(df, ("g",), rows=few).collect()}
        assert all(abs(got[g] - plain(*v)) < 1e-9 for g, v in groups.items()) and len(got) == 3
    twice = {r["g"]: (r["n"], r["dcor"]) for r in statistics.distance_correlation(df.unionByName(df), ("g",), rows=10).collect()}
    assert all(twice[g][0] == 800 and abs(twice[g][1] - got[g]) < 1e-9 for g in groups)
