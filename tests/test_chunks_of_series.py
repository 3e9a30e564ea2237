"""Measures of series that are cut into chunks: no task sorts a series, and results don't depend on the cuts."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import measures, windows


@pytest.fixture(scope="module")
def nav(spark):
    rng = np.random.default_rng(5)
    rows = [(name, k, float(v)) for name, n in (("a", 300), ("b", 15), ("c", 1)) for k, v in enumerate(np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.1, n))), 2))]
    return spark.createDataFrame(rows, "series_id string, seq long, nav double").cache()


def test_lags_and_peaks_across_chunks(nav, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 7)
    want = nav.toPandas().sort_values(["series_id", "seq"], ignore_index=True)
    by = want.groupby("series_id")["nav"]
    got = windows.with_lags(nav, 10).toPandas().sort_values(["series_id", "seq"], ignore_index=True)
    for k in (1, 2, 10):
        pd.testing.assert_series_equal(got[f"before{k}"], by.shift(k), check_names=False)
    got = windows.with_peak(nav).toPandas().sort_values(["series_id", "seq"], ignore_index=True)
    pd.testing.assert_series_equal(got["peak"], by.cummax(), check_names=False)


def test_all_metrics_do_not_depend_on_chunks(nav, monkeypatch):
    whole = {r["series_id"]: r for r in measures.all_metrics(nav).collect()}
    monkeypatch.setattr(windows, "CHUNK", 64)
    cut = {r["series_id"]: r for r in measures.all_metrics(nav).collect()}
    assert whole.keys() == cut.keys() and whole["a"]["hurst_exponent"] is not None
    for k, r in whole.items():
        for x, y in zip(r, cut[k], strict=True):
            assert x == y or x == pytest.approx(y, rel=1e-9), (k, r, cut[k])
