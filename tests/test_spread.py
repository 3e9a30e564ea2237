"""Grid neighbours, ranks by ranges, running sums, summed regressions and segmentation against plain numpy."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import measures, neighbours, segmentation, spread, statistics, windows


def series(spark, **values):
    rows = [(k, i, None if x is None else float(x)) for k, v in values.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, seq long, nav double")


def plain_pairs(points, r):
    near = (np.abs(points[:, None, :] - points[None, :, :]) <= r).all(2)
    return int(np.triu(near, 1).sum())


@pytest.mark.parametrize("fine", [1, 3, None])
def test_matching_pairs_against_all_pairs(spark, fine):
    rng = np.random.default_rng(3)
    sets = {
        "normal": (rng.normal(0, 1, (150, 2)), 0.3), "ties": (rng.integers(0, 4, (150, 2)).astype(float), 1.0), "one": (np.zeros((40, 2)), 1e-14),
        "far": (1e12 + rng.integers(0, 3, (60, 2)), 1e-9), "mixed": (np.r_[rng.normal(0, 1e-3, (80, 2)), rng.normal(0, 50, (80, 2))], 0.5), "edge": (np.arange(80, dtype=float).reshape(-1, 2) / 10, 0.3),
    }
    rows = [(k, float(a), float(b), float(r)) for k, (p, r) in sets.items() for a, b in p]
    rows += [("normal", None, 0.0, 0.3), ("normal", float("nan"), 0.0, 0.3), ("lonely", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, a double, b double, r double")
    for axes in (["a"], ["a", "b"]):
        got = {x.series_id: x.pairs for x in neighbours.matching_pairs(df, "series_id", axes, "r", fine).collect()}
        want = {k: plain_pairs(p[:, : len(axes)], r) for k, (p, r) in sets.items()}
        if axes == ["a"]:
            want["normal"] = plain_pairs(sets["normal"][0][:, :1], 0.3)
        assert got == {k: v for k, v in want.items() if v}


def test_salted_cells_give_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = np.r_[rng.normal(0, 0.01, (200, 3)), rng.normal(0, 1, (200, 3))]
    df = spark.createDataFrame([("a", *map(float, p), 0.2) for p in points], "series_id string, a double, b double, c double, r double")
    monkeypatch.setattr(neighbours, "SALTED", 50)
    assert neighbours.matching_pairs(df, "series_id", ["a", "b", "c"], "r", 2).first().pairs == plain_pairs(points, 0.2)


def plain_sample_entropy(x, m, r):
    counts = []
    for length in (m, m + 1):
        w = np.lib.stride_tricks.sliding_window_view(x, length)[: len(x) - length]
        counts.append(plain_pairs(w, r))
    return 1 - counts[1] / counts[0] if all(counts) else None


def test_sample_entropy_of_any_length(spark):
    rng = np.random.default_rng(1)
    made = {"walk": rng.normal(0, 1, 400).cumsum(), "noise": rng.normal(0, 1, 500), "steps": rng.integers(0, 5, 300), "flat": np.ones(200), "short": [1.0, 2.0, 3.0]}
    nav = series(spark, **made)
    r = {x.series_id: x.tolerance for x in measures.mad_tolerance(nav).collect()}
    for m in (1, 2, 3):
        got = {x.series_id: x.sample_entropy for x in measures.sample_entropy(nav, m, least=4).collect()}
        assert got.pop("short") is None
        assert set(got) == set(made) - {"short"}
        for k, v in got.items():
            want = plain_sample_entropy(np.asarray(made[k], float), m, r[k])
            assert v is want is None or math.isclose(v, want, abs_tol=1e-12), (m, k)
    assert {x.sample_entropy for x in measures.sample_entropy(nav, 2, least=1000).collect()} == {None}


def test_ranks_by_ranges_equal_sorted_ranks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(spread, "ROWS", 7)
    values = {"a": rng.lognormal(0, 4, 300), "b": rng.integers(0, 9, 300).astype(float), "c": [2.0], "d": np.r_[rng.normal(0, 1, 50), np.inf, -np.inf, np.nan, np.nan], "e": np.r_[np.full(100, 3.0), 1e300, -1e300]}
    rows = [(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)] + [("a", 1000, None)]
    df = spark.createDataFrame(rows, "feature string, seq long, value double")
    got = spread.average_ranks(df, ["feature"]).toPandas()
    assert got[got["value"].isna() & (got["seq"] == 1000)]["rank"].isna().all()
    for k, v in values.items():
        mine = got[(got["feature"] == k) & (got["seq"] < 1000)].sort_values("seq")["rank"].to_numpy()
        want = pd.Series(np.where(np.isnan(v), np.inf, np.where(v == np.inf, 1e308, v))).rank().to_numpy()
        np.testing.assert_array_equal(mine, want, k)
    at = spread.at_position(df.filter("feature = 'a' and value is not null"), ["feature"], "value", middle=F.floor(F.col("n") / 2), last=F.col("n") - 1).first()
    assert (at.n, at.middle, at.last) == (300, sorted(values["a"])[150], max(values["a"]))
    ranked = windows.rank_normalize(series(spark, a=[3, 1, 1, None], b=[7]), "nav")
    assert sorted((r.series_id, r.seq, r.ranked) for r in ranked.filter("ranked is not null").collect()) == [("a", 0, 1.0), ("a", 1, 0.25), ("a", 2, 0.25), ("b", 0, 0.5)]


def test_running_sums_across_ranges(spark):
    rows = [("a", i // 2, i) for i in range(100)] + [("b", 5, 1)]
    got = spread.running_sums(spark.createDataFrame(rows, "k string, at long, x long"), ["k"], "at", {"before": "x"}, span=7).collect()
    assert len(got) == 101
    for r in got:
        assert r.before == (sum(range(2 * r["at"])) if r.k == "a" else 0)


def plain_adf(x):
    n, x = len(x), x - np.mean(x)
    lags = min(12, math.floor((n - 1) ** (1 / 3) + 1e-9))
    dx = np.diff(x)
    y = dx[lags:]
    design = np.column_stack([x[lags:-1], np.ones(len(y)), *(dx[lags - k : -k] for k in range(1, lags + 1))])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ beta
    return beta[0] / math.sqrt(left @ left / (len(y) - design.shape[1]) * np.linalg.inv(design.T @ design)[0, 0]), lags


def test_stationarity_equals_the_regression_of_a_whole_series(spark):
    rng = np.random.default_rng(11)
    made = {"noise": rng.normal(0, 1, 50), "walk": 1e6 + rng.normal(0, 1, 900).cumsum(), "long": rng.normal(5, 0.1, 3000), "cube": rng.normal(0, 1, 217).cumsum()}
    nav = series(spark, **made, short=rng.normal(0, 1, 49), flat=np.ones(80))
    long = nav.select("series_id", F.lit("f").alias("feature"), "seq", F.col("nav").alias("value")).unionByName(spark.createDataFrame([("noise", "f", 1000, None)], "series_id string, feature string, seq long, value double"))
    got = {r.series_id: r for r in statistics.stationarity(long).collect()}
    for k, x in made.items():
        want, lags = plain_adf(x)
        assert got[k].lags == lags and math.isclose(got[k].statistic, want, rel_tol=1e-8), k
        assert got[k].stationary == (want < -2.86)
    assert [(got[k].statistic, got[k].stationary) for k in ("short", "flat")] == [(None, None)] * 2


def plain_segments(x, width, limit):
    """Changes and the profile of the whole series, by all windows against all."""

    def profile(lo, hi):
        part = segmentation.unit_windows(x[lo:hi], width)
        n = len(part)
        alike = np.round(part @ part.T, 9)
        away = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
        alike[away < max(1, width // 2)] = -np.inf
        order = np.lexsort((np.tile(np.arange(n), (n, 1)), -alike), axis=1)[:, :3]
        middle = np.sort(order, axis=1)[:, 1]
        out = []
        for s in range(5 * width, n - 5 * width + 1):
            told, real = middle < s, np.arange(n) < s
            score = round(((told & real).sum() / s + (~told & ~real).sum() / (n - s)) / 2, 9)
            ranks = pd.Series(told.astype(float)).rank().to_numpy()[:s].sum()
            out.append((s, score, (ranks - s * (n + 1) / 2) / math.sqrt(s * (n - s) * (n + 1) / 12)))
        return out

    changes, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo - width + 1 < 10 * width:
            continue
        s, score, z = max(profile(lo, hi), key=lambda r: (r[1], -r[0]))
        if abs(z) >= limit:
            changes.append((lo + s, score))
            todo += [(lo, lo + s), (lo + s, hi)]
    return sorted(changes), profile(0, len(x))


@pytest.mark.parametrize("block", [None, 64])
def test_segmentation_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    t = np.arange(170)
    x = np.r_[np.sin(t / 3), np.sign(np.sin(t / 5)), np.sin(t * 1.1)][:500] + rng.normal(0, 0.05, 500)
    changes, profile, _ = segmentation.split_series(series(spark, a=x, b=x[:90]), 12, block=block)
    limit = -NormalDist().inv_cdf(1e-15 / 2)
    want, whole = plain_segments(x, 12, limit)
    got = sorted((r["at"], r.score) for r in changes.collect())
    assert len(want) == 2 and [abs(a - b) < 15 for a, b in zip((c for c, _ in want), (170, 340), strict=True)] == [True, True]
    assert got == want
    found = {r["at"]: (r.score, r.z) for r in profile.collect()}
    assert {k: v[0] for k, v in found.items()} == {s: score for s, score, _ in whole}
    assert all(math.isclose(found[s][1], z, rel_tol=1e-9, abs_tol=1e-9) for s, _, z in whole)


def test_segment_features(spark):
    rng = np.random.default_rng(6)
    x = np.r_[np.sin(np.arange(200) / 2), np.sin(np.arange(200) / 6)] + rng.normal(0, 0.05, 400)
    nav = series(spark, two=x, noise=rng.normal(0, 1, 300), short=x[:99], flat=np.ones(150), brief=x[:103])
    got = {r.series_id: r for r in segmentation.segment_features(nav).collect()}
    two = got["two"]
    assert (two.n_changepoints, two.n_segments, two.first_cp_idx, two.last_cp_idx) == (1, 2, two.max_score_idx, two.max_score_idx)
    assert abs(two.first_cp_idx - 200) < 20 and two.profile_max > 0.9 and two.segment_mean_len == 200.0 and two.cp_density == 1 / 400
    assert 10 <= two.window_size <= 40
    assert got["noise"].n_changepoints == 0 and got["noise"].first_cp_idx == -1
    assert got["short"].n_segments is None and got["flat"].window_size == 10
    assert got["brief"].n_segments == 1 and got["brief"].profile_max is None


def test_window_length_of_chunks_equals_that_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(7)
    nav = series(spark, a=np.sin(np.arange(3000) / 9) + rng.normal(0, 0.1, 3000))
    one = segmentation.window_lengths(segmentation.numbered(nav)).first().width
    monkeypatch.setattr(segmentation, "CHUNK", 1100)
    assert segmentation.window_lengths(segmentation.numbered(nav)).first().width == one > 10


def test_windows_meet_rows_by_cells(spark):
    rng = np.random.default_rng(12)
    nav = series(spark, a=rng.normal(0, 1, 230), b=[1.0, None, 3.0] * 20)
    lengths = nav.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    rows = {(r.series_id, r.seq): r.nav for r in nav.collect()}
    for expanding in (True, False):
        cut = windows.walk_forward_windows(lengths, 20, 7, anchors=2, spacing=5, step=3, expanding=expanding)
        want = {}
        for w in cut.collect():
            for (s, q), v in rows.items():
                if s == w.series_id and w.train_start <= q < w.test_end:
                    want.setdefault((s, w.anchor, w.window, "train" if q < w.train_end else "test"), []).append((q, v))
        met = {}
        for r in windows.in_windows(nav, cut).collect():
            met.setdefault((r.series_id, r.anchor, r.window, r.part), []).append((r.seq, r.nav))
        assert {k: sorted(v) for k, v in met.items()} == {k: sorted(v) for k, v in want.items()} and len(want) > 50
        for r in windows.window_totals(nav, cut).collect():
            own = want.pop((r.series_id, r.anchor, r.window, r.part))
            values = [v for _, v in own if v is not None]
            assert (r.n, r.n_valid) == (len(own), len(values)) and math.isclose(r.total, sum(values), abs_tol=1e-9)
        assert not want


def test_rank_against_counts_strictly_smaller(spark):
    values, reference = series(spark, a=[1, 2, 2, 3, None], b=[1]), series(spark, a=[2, 2, 1, 5])
    got = {(r.series_id, r.seq): r.share for r in windows.rank_against(values, reference).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 0.25, ("a", 2): 0.25, ("a", 3): 0.75, ("a", 4): 0.5, ("b", 0): 0.5}
