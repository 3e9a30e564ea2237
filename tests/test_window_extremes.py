"""Extremes of windows by blocks, against the rows of each window."""

import numpy as np

from tidemark.operators import windows


def test_extremes_equal_the_windows_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.normal())) for s, n in (("a", 700), ("b", 131)) for i in range(n)]
    nav = spark.createDataFrame(rows, "series_id string, seq long, nav double")
    sizes = spark.createDataFrame([("a", 700), ("b", 131)], "series_id string, n long")
    for expanding in (True, False):
        walk = windows.walk_forward_windows(sizes, 30, 10, step=7, expanding=expanding)
        want = windows.evaluate(nav, walk, lambda train, test: test["nav"].max() - train["nav"].min())
        got = windows.evaluate_extremes(nav, walk, lambda train, test: test["high"] - train["low"])
        assert got.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
