"""Causal links of a known graph of ten series, and partial correlations against regressions."""

import numpy as np
import pytest

from tidemark.operators import links


def graph(rng, n=3000):
    """Ten series: a chain f0 -> f1 -> f2, a common cause f3 of f4 and the target, own pasts, and the target from f2 and f3."""
    x = rng.normal(0, 1, (n, 10))
    for t in range(3, n):
        x[t, 0] += 0.6 * x[t - 1, 0]
        x[t, 1] += 0.7 * x[t - 1, 0]
        x[t, 2] += 0.7 * x[t - 2, 1]
        x[t, 3] += 0.4 * x[t - 1, 3]
        x[t, 4] += 0.8 * x[t - 1, 3]
        x[t, 9] += 0.6 * x[t - 1, 2] - 0.7 * x[t - 3, 3] + 0.3 * x[t - 1, 9]
    return x


def frames(spark, x):
    long = spark.createDataFrame([("s", i, f"f{j}", float(v)) for j in range(x.shape[1] - 1) for i, v in enumerate(x[:, j])], "series_id string, seq long, feature string, value double")
    return long, spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x[:, -1])], "series_id string, seq long, target double")


def test_known_graph_is_found(spark):
    long, target = frames(spark, graph(np.random.default_rng(1)))
    got = {r.feature: r.linked for r in links.causal_features(long, target, 3, 0.001).collect()}
    assert {f for f, linked in got.items() if linked} == {"f2", "f3"} and len(got) == 9
    strong = {r.feature: r for r in links.causal_strengths(long, target, 3).collect()}
    assert (strong["f2"].best_lag, strong["f3"].best_lag) == (1, 3) and strong["f2"].causal_strength > 0.3 < strong["f3"].causal_strength
    assert strong["f2"].min_pvalue < 1e-12 and strong["f5"].min_pvalue > 1e-4


def test_partial_correlations_equal_regressions(spark):
    rng = np.random.default_rng(2)
    x = graph(rng, 400)
    long, target = frames(spark, x)
    n, matrices = links.lagged_correlations(long, target, 4, [f"f{j}" for j in range(9)])
    z = (x - x.mean(0)) / x.std(0)
    assert n == 400
    for k in range(5):
        np.testing.assert_allclose(matrices[k], z[k:].T @ z[: 400 - k] / (400 - k), atol=1e-9)
    given = [(0, 0), (3, 0), (4, 0)]
    own = links.Tests(n, matrices).partial((1, 0), (2, 0), given)[0]
    design = z[:, [0, 3, 4]]
    left = [z[:, j] - design @ np.linalg.lstsq(design, z[:, j], rcond=None)[0] for j in (1, 2)]
    assert own == pytest.approx(left[0] @ left[1] / np.sqrt((left[0] @ left[0]) * (left[1] @ left[1])), abs=1e-9)


def test_missing_rows_and_short_series(spark):
    long, target = frames(spark, graph(np.random.default_rng(3), 60))
    assert links.lagged_correlations(long.filter("seq <> 7 or feature <> 'f1'"), target.filter("seq <> 9"), 1, [f"f{j}" for j in range(9)])[0] == 58
    assert links.causal_tests(long.filter("seq < 40"), target) == [] and links.causal_strengths(long.filter("seq < 40"), target).count() == 0
    flat = long.unionByName(long.filter("feature = 'f0'").selectExpr("series_id", "seq", "'flat' as feature", "1.0D as value"))
    assert {r.feature: r.causal_strength for r in links.causal_strengths(flat, target, 1).collect()}["flat"] == 0.0
