"""Distribution tests, block lengths, resampling and calendar bars against published values and plain code."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, distribution, resampling


def long_frame(spark, **values):
    rows = [("s", k, i, None if x is None else float(x)) for k, v in values.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, feature string, seq long, value double")


def test_shapiro_wilk_of_the_published_example():
    """Shapiro and Wilk (1965), weights of eleven men: W is 0.79; p by Royston's approximation is 0.0067."""
    w, p = distribution.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.7888, abs=1e-3) and p == pytest.approx(0.0067, abs=1e-3)
    from statistics import NormalDist

    grid = np.array([NormalDist().inv_cdf((i - 0.5) / 200) for i in range(1, 201)])
    w, p = distribution.shapiro_wilk(grid)
    assert w > 0.998 and p > 0.99
    assert all(map(math.isnan, distribution.shapiro_wilk(np.ones(30))))


def test_shapiro_takes_the_first_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    long = long_frame(spark, normal=rng.normal(0, 1, 400), skewed=rng.exponential(1, 400), few=[1, 2, 3], flat=np.ones(40), gaps=[None, *rng.normal(0, 1, 30), float("nan")])
    got = {r.feature: r for r in distribution.shapiro(long).collect()}
    assert got["normal"].shapiro_w > 0.98 and got["skewed"].gaussianity == "substantial_non_normality" and got["skewed"].shapiro_p < 1e-10
    assert [(got[k].shapiro_w, got[k].gaussianity) for k in ("few", "flat")] == [(None, "unknown")] * 2
    assert got["gaps"].shapiro_w > 0.9
    monkeypatch.setattr(distribution, "SHAPIRO_ROWS", 50)
    values = [r.value for r in long.filter("feature = 'normal'").orderBy("seq").limit(50).collect()]
    assert distribution.shapiro(long.filter("feature = 'normal'")).first().shapiro_w == pytest.approx(distribution.shapiro_wilk(np.array(values))[0])


def test_beta_functions():
    assert distribution.digamma(np.array([1.0, 0.5]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert distribution.digamma(np.array([0.5]))[0] == pytest.approx(-1.9635100260214235, abs=1e-11)
    assert distribution.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-10)
    x = np.array([0.0, 0.2, 0.5, 0.9, 1.0])
    np.testing.assert_allclose(distribution.beta_cdf(x, 2, 3), 6 * x**2 - 8 * x**3 + 3 * x**4, atol=1e-12)
    np.testing.assert_allclose(distribution.beta_cdf(x, 1, 1), x, atol=1e-12)
    np.testing.assert_allclose(distribution.beta_cdf(x[1:4], 0.5, 0.5), 2 / math.pi * np.arcsin(np.sqrt(x[1:4])), atol=1e-10)


def test_beta_goodness(spark):
    rng = np.random.default_rng(3)
    sets = {"good": rng.beta(2, 5, 600), "flat": rng.random(300), "two": np.r_[rng.beta(60, 40, 300), rng.beta(20, 80, 300)], "ties": np.round(rng.beta(3, 3, 200), 1), "few": [0.1, 0.2], "one": np.full(20, 0.5)}
    long = long_frame(spark, **sets)
    got = {r.feature: r for r in distribution.beta_goodness(long).collect()}
    assert got["good"].fits_well and got["good"].alpha == pytest.approx(2, rel=0.2) and got["good"].beta == pytest.approx(5, rel=0.2)
    assert got["flat"].alpha == pytest.approx(1, rel=0.2) and not got["two"].fits_well and (got["two"].ad_p_value, got["two"].stage_used) == (pytest.approx(0.001), 2)
    assert got["few"].alpha is None and got["one"].ad_statistic is None and got["one"].n == 20
    for k in ("good", "two", "ties"):
        x = np.sort(np.clip(sets[k], 1e-10, 1 - 1e-10))
        assert got[k].ad_statistic == pytest.approx(distribution.anderson_darling(x, got[k].alpha, got[k].beta), rel=1e-8)
        # The fit is where the likelihood is flat.
        a, b = np.array([got[k].alpha]), np.array([got[k].beta])
        assert distribution.digamma(a)[0] - distribution.digamma(a + b)[0] == pytest.approx(np.log(x).mean(), abs=1e-8)
    again = {r.feature: r.ad_p_value for r in distribution.beta_goodness(long.repartition(7)).collect()}
    assert again == {k: r.ad_p_value for k, r in got.items()}


def ar1(rng, n, phi):
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.normal()
    return x


def test_block_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    made = {"half": ar1(rng, 4000, 0.5), "noise": rng.normal(0, 1, 4000), "flat": np.ones(50), "few": [1.0, 2.0]}
    rows = [(k, i, float(x)) for k, v in made.items() for i, x in enumerate(v)]
    nav = spark.createDataFrame(rows, "series_id string, seq long, nav double")
    got = {r.series_id: r for r in resampling.block_lengths(nav).collect()}
    # Of an autoregression the length is known: (1.5 (2 phi / (1 - phi^2))^2 n)^(1/3).
    assert got["half"].circular == pytest.approx((1.5 * (1 / 0.75) ** 2 * 4000) ** (1 / 3), rel=0.35)
    assert got["half"].stationary == pytest.approx(got["half"].circular * (2 / 3) ** (1 / 3), rel=1e-9)
    assert got["noise"].block_length < 10 and got["flat"].block_length == got["few"].block_length == 2
    monkeypatch.setattr(resampling, "CHUNK", 300)
    points = nav.filter("series_id = 'half'").select("series_id", F.col("seq").alias("at"), F.col("nav").alias("x"))
    x = made["half"] - made["half"].mean()
    sizes = spark.createDataFrame([("half", 4000, float(made["half"].mean()), 40)], "series_id string, n long, mean double, most int")
    for r in resampling.autocovariances(points, sizes).collect():
        assert r["cov"] == pytest.approx(x[r.lag :] @ x[: len(x) - r.lag] / 4000, abs=1e-9)


def test_bootstrap_by_blocks_equals_weights_of_rows(spark):
    """Weights of blocks give what weights of their rows do; the spread is that of resampled correlations."""
    rng = np.random.default_rng(6)
    y = rng.normal(0, 1, 600)
    long = long_frame(spark, near=y + rng.normal(0, 0.5, 600), far=rng.normal(0, 1, 600))
    target = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series_id string, seq long, target double")
    got = {r.feature: r for r in resampling.bootstrap_importance(long, target, 40, block=20).collect()}
    assert got["near"].mean_importance == pytest.approx(0.8, abs=0.08) and got["far"].mean_importance < 0.05 and 0 < got["near"].std_importance < 0.1
    assert resampling.bootstrap_importance(long, target, 5).count() == 2


def plain_bars(ticks, threshold):
    out, bar, number = [], None, 0
    for seq, price in ticks:
        if bar is None:
            bar, number = [price, price, price, price, 1.0, seq, seq, 1], 0
            continue
        bar = [bar[0], max(bar[1], price), min(bar[2], price), price, bar[4] + 1, bar[5], seq, bar[7] + 1]
        if (bar[1] - bar[2]) / bar[0] >= threshold:
            out.append((number, *bar, False))
            bar, number = [price, price, price, price, 0.0, seq, seq, 0], number + 1
    return out + ([(number, *bar, True)] if bar and bar[7] else [])


def test_period_bars_restart_at_calendar_borders(spark):
    rng = np.random.default_rng(7)
    first = datetime.date(2021, 12, 1)
    days = [first + datetime.timedelta(days=int(d)) for d in range(90)]
    prices = 100 * np.cumprod(1 + rng.normal(0, 0.01, 90))
    ticks = spark.createDataFrame([("s", i, d, float(p), 1.0) for i, (d, p) in enumerate(zip(days, prices, strict=True))] + [("s", 200, None, 1.0, 1.0), ("s", 201, days[-1], -1.0, 1.0)], "series_id string, seq long, ts date, price double, quantity double")
    names = ("bar", "open", "high", "low", "close", "volume", "start_seq", "end_seq", "n_trades", "is_orphan")
    for period, key in (("year", lambda d: d.replace(month=1, day=1)), ("month", lambda d: d.replace(day=1))):
        want = {}
        for i, (d, p) in enumerate(zip(days, prices, strict=True)):
            want.setdefault(key(d), []).append((i, float(p)))
        want = sorted((k, *b) for k, v in want.items() for b in plain_bars(v, 0.05))
        got = sorted((r.period, *(r[n] for n in names)) for r in bars.period_bars(ticks, 0.05, period=period).collect())
        assert got == want and any(r[-1] for r in got)
    part = bars.period_bars(ticks, 0.05, start="2022-01-10", end="2022-01-20").collect()
    assert min(r.start_seq for r in part) == 40 and max(r.end_seq for r in part) == 50
