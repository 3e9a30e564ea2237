"""Nearest-neighbour information against all pairs of points and a known value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import information
from tidemark.operators.distribution import digamma


def plain_distances(x, y, k):
    far = np.maximum(np.abs(np.subtract.outer(x, x)), np.abs(np.subtract.outer(y, y)))
    np.fill_diagonal(far, np.inf)
    return np.sort(far, axis=1)[:, k - 1]


def plain_information(x, y, k):
    eps = plain_distances(x, y, k)[:, None]
    inner = lambda v: (np.abs(np.subtract.outer(v, v)) < eps * (1 - 1e-9)).sum(1) - 1
    n = np.array([float(len(x))])
    return max(0.0, float(digamma(n)[0] + digamma(np.array([float(k)]))[0] - digamma(inner(x) + 1.0).mean() - digamma(inner(y) + 1.0).mean()))


@pytest.mark.parametrize("cell", [None, 12])
def test_information_against_all_pairs(spark, cell):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, 500)
    made = {"tied": 0.9 * y + math.sqrt(1 - 0.81) * rng.normal(0, 1, 500), "steps": np.floor(y * 2), "free": rng.normal(0, 1, 500), "curve": y * y, "flat": np.ones(500), "few": y[:20], "odd": np.r_[np.nan, np.inf, rng.normal(0, 1, 60)]}
    long = spark.createDataFrame([("s", i, f, float(v)) for f, vs in made.items() for i, v in enumerate(vs)] + [("s", 3, "gap", None)], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series_id string, seq long, target double")
    points = information.scaled_points(long, target).withColumn("id", F.xxhash64("series_id", "seq"))
    got = {r.feature: r.information for r in information.neighbour_information(long, target, 3, cell).collect()}
    assert got["few"] is None and got["gap"] is None
    rows = points.collect()
    for f in ("tied", "steps", "free", "curve", "odd"):
        own = sorted((r.seq, r.x, r.y) for r in rows if r.feature == f)
        x, z = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        assert got[f] == pytest.approx(plain_information(x, z, 3), abs=1e-9), f
    assert got["tied"] == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.12) and got["free"] < 0.1 < got["curve"] and got["flat"] < 0.05


def test_distances_of_dense_and_lone_points(spark):
    rng = np.random.default_rng(4)
    p = np.r_[rng.normal(0, 1e-3, (200, 2)), rng.normal(0, 5, (60, 2)), [[100.0, -100.0]]]
    df = spark.createDataFrame([("f", i, len(p), float(a), float(b)) for i, (a, b) in enumerate(p)], "feature string, id long, n long, x double, y double")
    got = {r.id: r.distance for r in information.neighbour_distances(df, 3, 10).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(p))], plain_distances(p[:, 0], p[:, 1], 3), rtol=1e-12)
