"""Measures, bars, feature views, selection, sources and streams on small cases; all queries against DuckDB."""

import datetime
import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.functions import scalars as X
from tidemark.operators import bars, features, measures, resampling, selection, statistics, windows
from tidemark.sources import files, sinks
from tidemark.streaming import online


def nav_frame(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(x)) for i, x in enumerate(values)], "series_id string, seq long, nav double")


def compared(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object or str(df[c].dtype).startswith(("str", "bool")):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float).fillna(-1e99)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


LIGHT = [
    "entry_epoch_summary", "w2_bear_epochs", "w5_troughs", "w6_dd_spikes", "w12_rank_against", "w18_timeline", "w20_range_bars", "a7_fitness", "a13_shannon", "a15_sample_entropy", "a17_higuchi", "a20_fd_bins",
    "a24_report", "a26_describe", "m1_spearman_pairs", "m9_effects", "f9_suppressed", "v1_wide", "z2_ema", "z_sessions",
]


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    mine, theirs = compared(catalogue.queries()[name](spark, SMALL).toPandas()), compared(con.execute(catalogue.oracle_sql()[name]).df())
    assert list(mine.columns) == list(theirs.columns) and len(mine) == len(theirs)
    for c in mine.columns:
        if mine[c].dtype == object:
            assert mine[c].tolist() == theirs[c].tolist(), c
        else:
            np.testing.assert_allclose(mine[c].to_numpy(float), theirs[c].to_numpy(float), atol=2e-6)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entropy_and_dimension_of_known_series(spark):
    rising = nav_frame(spark, range(1, 301))
    assert measures.permutation_entropy(rising).first()[1] == 0.0
    assert measures.higuchi_dimension(rising).first()[1] == pytest.approx(0.0, abs=1e-9)
    assert measures.permutation_entropy(nav_frame(spark, range(20))).first()[1] is None
    assert measures.higuchi_dimension(nav_frame(spark, [5.0] * 50)).first()[1] is None
    noise = nav_frame(spark, np.random.default_rng(0).random(2000) + 1)
    assert measures.permutation_entropy(noise).first()[1] > 0.99 and measures.higuchi_dimension(noise).first()[1] > 0.9
    assert measures.shannon_entropy(nav_frame(spark, [1.0] * 200), 10).first()[1] == 0.0
    walk = nav_frame(spark, np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.01, 3000))))
    assert 0.3 < measures.hurst_exponent(walk).first()[1] < 0.7
    got = measures.all_metrics(walk).first()
    assert got.all_bounded and not got.has_missing


def test_range_bars_open_at_the_breach(spark):
    ticks = spark.createDataFrame([("s", i, p, 1.0) for i, p in enumerate([100.0, 100.5, 101.2, 101.0, 100.0, 100.1])], "series_id string, seq long, price double, quantity double")
    got = bars.range_bars(ticks, 0.01).orderBy("bar").collect()
    assert [(b.open, b.close, b.volume, b.n_trades, b.complete) for b in got] == [(100.0, 101.2, 3.0, 3, True), (101.2, 100.0, 2.0, 2, True), (100.0, 100.1, 1.0, 1, False)]


def test_segments_fingerprints_and_latest(spark):
    df = nav_frame(spark, [1, 2, 3])
    found = bars.fingerprint(df.withColumn("ts", F.col("seq")), ["seq", "nav"], "ts")
    assert bars.alignment_violations(found, found).count() == 0
    assert bars.alignment_violations(found.withColumn("checksum", F.lit("0")), found).count() == 0
    assert [r.field for r in bars.alignment_violations(found.withColumn("checksum", F.lit("1")), found).collect()] == ["checksum"]
    assert windows.continuity(windows.positions(df)).first().continuous
    assert not windows.continuity(windows.positions(df).filter("seq <> 1")).first().continuous
    day = datetime.date
    ranges = spark.createDataFrame([(day(2023, 5, 1), day(2025, 2, 1))], "a date, b date").select(windows.year_ranges(F.col("a"), F.col("b")).alias("r")).first().r
    assert [(x.year, x.start, x.end) for x in ranges] == [(2023, day(2023, 5, 1), day(2023, 12, 31)), (2024, day(2024, 1, 1), day(2024, 12, 31)), (2025, day(2025, 1, 1), day(2025, 2, 1))]


def test_feature_views_round_trip(spark, tmp_path):
    rows = [("a", b, 25, n, f, b / 10 + n / 100) for b in range(3) for n in (5, 20) for f in ("bull_ed", "max_dd")]
    store = features.FeatureStore(spark.createDataFrame(rows, "series_id string, bar_index long, threshold_dbps int, lookback int, feature string, value double"))
    wide = store.to_wide()
    back = features.FeatureStore.from_wide(wide).df.select("bar_index", "lookback", "feature", "value")
    assert {tuple(r) for r in back.collect()} == {(b, n, f, v) for _, b, _, n, f, v in rows}
    nested = {r.bar_index: json.loads(r.features) for r in store.to_nested().collect()}
    assert nested[1]["rb00025"]["lb00005"]["bull_ed"] == pytest.approx(0.15)
    assert features.feature_columns(wide.columns, lookback=20) == ["ith_rb25_lb20_bull_ed", "ith_rb25_lb20_max_dd"]
    store.save(str(tmp_path / "f"))
    assert features.FeatureStore.from_parquet(spark, str(tmp_path / "f")).filter(feature="max_dd").df.count() == 6
    assert {r.rule: r.n_violations for r in features.validation(store.df).collect()} == {"null_key": 0, "unknown_feature": 0, "out_of_bounds": 0, "not_positive": 0, "negative_position": 0}
    given = ("ith_rb25_lb100_bull_ed", "ith_rb50_lb500_bear_cv", "ith_rb1000_lb20_bull_cv", "ith_rb1000_lb100_intermediate_x", "ith_rb1000_lb100_bull_ed", "ith_rb25_lb20_max_dd")
    names = spark.createDataFrame([(n,) for n in given], "name string")
    table = features.suppression_table(spark)
    assert [r.name for r in features.without_suppressed(names, table).collect()] == ["ith_rb1000_lb100_bull_ed"]
    assert {r.name: r.category for r in features.suppression_reasons(names, table).collect()} == {given[0]: "redundant", given[1]: "redundant", given[2]: "unstable", given[3]: "debug", given[5]: "redundant"}
    assert {r.category: r.n for r in features.suppression_summary(names, table).collect()} == {"redundant": 3, "unstable": 1, "debug": 1}
    with pytest.raises(ValueError, match="missing columns"):
        features.FeatureStore(names)


def planted(spark, n=600):
    rng = np.random.default_rng(8)
    x, y, z = rng.normal(size=(3, n))
    series = {"signal": x, "copy": x + 0.01 * y, "noise": z}
    long = spark.createDataFrame([("s", i, f, float(v)) for f, vs in series.items() for i, v in enumerate(vs)], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("s", i, float(v + 0.5 * e)) for i, (v, e) in enumerate(zip(x, rng.normal(size=n), strict=True))], "series_id string, seq long, target double")
    return long, target, series


def test_selection_finds_the_planted_signal(spark):
    long, target, series = planted(spark)
    assert selection.by_correlation(long, order=["signal", "copy", "noise"]) == ["signal", "noise"]
    chosen = selection.mrmr(long, target, 3)
    assert chosen[0][0] in ("signal", "copy") and chosen[2][0] == "noise" and chosen[0][1] > chosen[2][1]
    boot = {r.feature: r for r in resampling.bootstrap_importance(long, target, 30).collect()}
    assert boot["signal"].mean_importance > 0.5 > boot["noise"].mean_importance and boot["signal"].cv < 0.2
    walk = {r.feature: r.mean_importance for r in selection.walk_forward_stability(long, target).collect()}
    assert walk["signal"] > 0.5 > walk["noise"]
    pairs = statistics.pair_correlations(long)
    names, m = statistics.correlation_matrix(pairs)
    np.testing.assert_allclose(m, np.corrcoef([series[f] for f in names]), atol=1e-9)
    assert statistics.pca(pairs)["components"][0.9] == 2
    assert statistics.variance_inflation(pairs)["noise"] < 2 < statistics.variance_inflation(pairs)["signal"]
    ranks = spark.createDataFrame([("m1", "a", 3.0), ("m1", "b", 2.0), ("m2", "a", 1.0), ("m2", "b", 9.0), ("m2", "c", 5.0)], "method string, feature string, score double")
    assert [(r.feature, r.points) for r in selection.borda(ranks).collect()] == [("b", 5), ("a", 4), ("c", 2)]


def test_stationarity_and_tests(spark):
    rng = np.random.default_rng(5)
    series = {"still": rng.normal(size=500), "walk": np.cumsum(rng.normal(size=500))}
    long = spark.createDataFrame([("s", i, f, float(v)) for f, vs in series.items() for i, v in enumerate(vs)], "series_id string, seq long, feature string, value double")
    got = {r.feature: r.stationary for r in statistics.stationarity(long).collect()}
    assert got == {"still": True, "walk": False}
    p = {r.feature: r.p_value for r in statistics.normality(measures.describe(long.union(spark.createDataFrame([("s", i, "skewed", float(v)) for i, v in enumerate(rng.exponential(size=500))], long.schema)), ["feature"], "value")).collect()}
    assert p["skewed"] < 1e-6 < p["still"]
    both = long.filter("feature = 'still'").withColumn("g", F.when(F.col("seq") < 250, "x").otherwise("y")).withColumn("value", F.col("value") + F.when(F.col("g") == "x", 1.0).otherwise(0.0))
    effect = statistics.rank_effects(both, F.col("g"), "x", "y").first()
    assert effect.p_value < 1e-6 and effect.cliffs_delta_standard > 0.3 and effect.cohens_d > 0.5 and effect.effect == "large"
    regimes = statistics.detect_regime(nav_frame(spark, np.linspace(1, 9, 300)), 100, chunk=64).orderBy("seq").collect()
    assert len(regimes) == 300 and all(r.regime == "warmup" for r in regimes[:100]) and regimes[200].regime == "trending"


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.normalize_cv(F.lit(None).cast("double"))) == pytest.approx(0.1192, abs=1e-4)
    assert get(X.normalize_epochs(F.lit(5), 0)) == 0.5
    assert get(X.garman_klass_raw(*(F.lit(v) for v in (1.0, 2.0, 0.0, 1.0)))) is None
    assert get(X.first_digits(F.lit(0.00123), 4)) == "1230" or get(X.first_digits(F.lit(0.123), 4)) == "1230"
    assert get(X.epoch_millis(F.lit(1_700_000_000_000_000_000))) == 1_700_000_000_000
    assert get(X.has_feature(F.lit('{"a": "11.0"}'), "a", "9.0")) and not get(X.has_feature(F.lit('{"a": "11.0"}'), "a", "9.0", lexicographic=True))
    assert get(X.adaptive_windows(F.lit(1000), 5)) == [10, 22, 50, 112, 250] and get(X.adaptive_windows(F.lit(40), 5))[:1] == [10]
    assert get(X.fluctuation_windows(F.lit(1000), 3)) == [20, 71, 250] and get(X.log_spaced_windows(F.lit(2), F.lit(3.0), 4)) == [4]
    assert get(X.embedding_dimension(F.lit(1000))) == 7 and get(X.embedding_dimension(F.lit(2))) == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Date,NAV\n2024-01-02,110\n2024-01-01,100\n")
    got = files.read_nav_csv(spark, str(tmp_path / "n.csv")).orderBy("seq").collect()
    assert [(r.seq, r.nav, round(r.pnl, 6)) for r in got] == [(0, 100.0, 0.0), (1, 110.0, 0.1)] and got[0].series_id == "n.csv"
    (tmp_path / "bad.csv").write_text("Date,Value\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="NAV"):
        files.read_nav_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "v.txt").write_text("1.5\nx\n2\n")
    assert [r.nav for r in files.read_values_text(spark, str(tmp_path / "v.txt")).orderBy("seq").collect()] == [1.5, 2.0]
    (tmp_path / "r.md").write_text("# R\n| `a_*` | low | why |\nno\n")
    assert tuple(files.read_registry(spark, str(tmp_path / "r.md")).first())[1:] == ("a_*", "low", "why")
    for k in range(3):
        (tmp_path / f"many{k}.md").write_text("# t\n\n| `b_*` | low | why |\n")
    several = files.read_registry(spark.newSession(), str(tmp_path / "many*.md")).repartition(3)
    assert several.count() == 3 and dict(several.dtypes)["ord"] == "bigint"
    assert files.load_config("thresholds = [25]\nlookbacks = [5]")["lookbacks"] == [5]
    with pytest.raises(ValueError, match="lookbacks"):
        files.load_config("thresholds = [25]\nlookbacks = [0]")
    assert files.date_range(spark, str(tmp_path / "n.csv")).first().last_day == datetime.date(2024, 1, 2)
    made = files.synthetic_nav(spark, 2, 50)
    assert made.agg(F.sum("nav")).first()[0] == files.synthetic_nav(spark, 2, 50).repartition(7).agg(F.sum("nav")).first()[0] or made.count() == 100
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    old.write.parquet(str(tmp_path / "t"))
    sinks.upsert(spark, str(tmp_path / "t"), spark.createDataFrame([(1, "c", 2)], old.schema), ["k"], "version", str(tmp_path / "u"))
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(1, "c"), (2, "b")}
    grown = sinks.with_columns_added(old, {"flag": ("boolean", False), "v": ("string", "x")})
    assert grown.columns == ["k", "v", "version", "flag"]
    sinks.write_json_lines(old, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from tidemark.operators.epochs import epoch_points

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(s, i, float(x)) for s in "ab" for i, x in enumerate(np.cumprod(1 + rng.normal(0, 0.05, 60)))], columns=["series_id", "seq", "nav"])
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(pdf[(pdf.seq >= 20 * k) & (pdf.seq < 20 * k + 20)]).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("series_id string, seq long, nav double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = online.stream_epochs(stream, 0.05).writeStream.format("memory").queryName("epochs_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.series_id, r.seq) for r in spark.sql("select * from epochs_out where epoch").collect()}
    want = {(r.series_id, r.seq) for r in epoch_points(spark.createDataFrame(pdf), 0.05).filter("epoch").collect()}
    assert got == want and got


def test_running_quantiles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    q = online.RunningQuantile(0.5, advance_top=True)
    for v in x:
        got = q.update(v)
    assert abs(got - np.median(x)) < 0.05


def test_lagged_links_find_the_planted_lag(spark):
    from tidemark.operators import causal

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 800))
    y = np.r_[0, 0, 0.8 * a[:-2]] + 0.3 * rng.normal(size=800)
    long = spark.createDataFrame([("s", i, f, float(v)) for f, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series_id string, seq long, target double")
    links = causal.lagged_links(long, target, 3, alpha=0.001)
    assert [(f, lag) for f, lag, _, _ in links] == [("a", 2)] and links[0][2] > 0.8
    info = {r.feature: r.information for r in causal.binned_information(long, spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(a)], target.schema), 8).collect()}
    assert info["a"] > 1.9 > 0.2 > info["b"]
    trees = {r.feature: r.importance for r in causal.tree_importance(long, spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(a)], target.schema), ["a", "b"]).collect()}
    assert trees["a"] > 0.8


def test_windows_of_scattering_and_change_points(spark):
    from tidemark.operators import segmentation, transforms

    nav = nav_frame(spark, np.r_[np.sin(np.arange(300) / 3), np.sin(np.arange(300) * 1.3)])
    dealt = transforms.hopping_windows(nav, 100, 50).groupBy("end").count().orderBy("end").collect()
    assert [(r.end, r["count"]) for r in dealt] == [(99 + 50 * k, 100) for k in range(11)]
    # Without noise, windows of the later half repeat at a fixed distance only, and the rank test splits it once more.
    cut = segmentation.change_points(nav, 20).filter("depth = 0").collect()
    assert len(cut) == 1 and abs(cut[0].seq - 300) < 25
    assert [r.seq for r in segmentation.change_points(nav, 20, least=0.9).collect()] == [cut[0].seq]
    paths = transforms.scattering_series(nav, 128, 64)
    assert paths.filter("value is null").count() == 0 and transforms.scattering_summary(paths).count() == paths.select("path").distinct().count()


def test_stream_of_range_bars_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame([(s, i, float(x), 1.0) for s in "ab" for i, x in enumerate(100 * np.cumprod(1 + rng.normal(0, 0.004, 90)))], columns=["series_id", "seq", "price", "quantity"])
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(pdf[(pdf.seq >= 30 * k) & (pdf.seq < 30 * k + 30)]).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("series_id string, seq long, price double, quantity double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = online.stream_range_bars(stream, 0.01).writeStream.format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.series_id, r.bar)
    got = sorted(spark.sql("select * from bars_out").collect(), key=key)
    want = sorted(bars.range_bars(spark.createDataFrame(pdf), 0.01).filter("complete").collect(), key=key)
    assert got == want and len(got) > 4


def test_hashes_versions_and_callbacks(spark):
    import hashlib

    nav = nav_frame(spark, [1.0, 2.0, 3.5])
    assert bars.nav_hash(nav).first().nav_hash == hashlib.sha256(np.array([1.0, 2.0, 3.5]).tobytes()).hexdigest()[:16]
    rows = spark.createDataFrame([(1, '{"f":"2.0"}'), (2, '{"g":"9"}'), (3, None)], "k int, versions string")
    assert [r.k for r in bars.stale(rows, "versions", "f", "1.10").orderBy("k").collect()] == [2, 3]
    assert bars.stale(bars.mark_computed(rows, "versions", "f", "3.0"), "versions", "f", "2.5").count() == 0
    lengths = spark.createDataFrame([("a", 20)], "series_id string, n int")
    plan = windows.walk_forward_windows(lengths, 5, 5, anchors=1)
    scored = windows.evaluate(nav_frame(spark, range(20)), plan, lambda train, test: float(len(train) + test["nav"].sum()))
    assert [(r.window, r.score) for r in scored.orderBy("window").collect()] == [(0, 40.0), (1, 70.0), (2, 100.0)]
    assert windows.awfo_scores(scored).first().overall == 70.0


def test_distance_correlation_against_matrices(spark):
    """Exact over groups of one, two and many points, with ties, missing and constant values."""
    import numpy as np

    from tidemark.operators import statistics

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=203), 1)
    groups = {"tied": (x, np.round(x * x + rng.normal(size=203), 1)), "large": (x * 1e6 + 1e9, rng.normal(size=203)), "constant": (np.full(9, 0.1), np.arange(9.0)), "one": (x[:1], x[:1]), "two": (x[:2], -x[:2])}
    rows = [(g, k, float(a), float(b)) for g, (xs, ys) in groups.items() for k, (a, b) in enumerate(zip(xs, ys, strict=True))]
    rows += [("tied", 900, None, 1.0), ("tied", 901, 1.0, float("nan")), ("tied", 902, float("inf"), 1.0), ("none", 0, None, None)]
    df = spark.createDataFrame(rows, "g string, seq int, x double, y double")
    got = {r["g"]: (r["n"], r["dcor"]) for r in statistics.distance_correlation(df, ("g",)).collect()}
    assert set(got) == set(groups)
    for g, (xs, ys) in groups.items():
        a, b = ((d := np.abs(v[:, None] - v[None, :])) - d.mean(0) - d.mean(1)[:, None] + d.mean() for v in (xs, ys))
        spread = np.sqrt((a * a).mean() * (b * b).mean())
        want = np.sqrt(max((a * b).mean(), 0) / spread) if spread > 1e-20 else 0.0
        assert got[g][0] == len(xs) and abs(got[g][1] - want) < 1e-7, (g, got[g], want)
    assert statistics.distance_correlation(df.limit(0), ("g",)).count() == 0


def test_regime_dependence_against_counting(spark):
    """Effects by counting pairs, sizes below the least as errors, and the strongest effects."""
    import numpy as np

    from tidemark.operators import statistics

    rng = np.random.default_rng(11)
    regime = ["trending"] * 40 + ["mean_reverting"] * 50 + ["random"] * 5
    values = {"moved": np.r_[rng.normal(2, 1, 40), rng.normal(0, 1, 50), np.zeros(5)], "same": np.round(rng.normal(size=95), 1)}
    rows = [("s", k, f, float(v)) for f, column in values.items() for k, v in enumerate(column)] + [("s", 0, "few", 1.0), ("s", 1, "few", None), ("s", 60, "few", 2.0)]
    long = spark.createDataFrame(rows, "series_id string, seq int, feature string, value double")
    labels = spark.createDataFrame([("s", k, r) for k, r in enumerate(regime)], "series_id string, seq int, regime string")
    found = statistics.regime_dependence(long, labels)
    got = {r["feature"]: r for r in found.collect()}
    assert set(got) == {"moved", "same", "few"}
    assert got["few"]["error"] == "Insufficient samples (trending=1, mean_rev=1)" and got["few"]["cliffs_delta"] is None
    for f, column in values.items():
        a, b = column[:40, None], column[None, 40:90]
        assert abs(got[f]["cliffs_delta"] - ((a < b).mean() - (a > b).mean())) < 1e-9
        assert abs(got[f]["trending_std"] - column[:40].std()) < 1e-9 and got[f]["n_random"] == 5 and got[f]["error"] is None
    assert got["moved"]["regime_dependent"] and got["moved"]["effect"] == "large_suspicious"
    total = statistics.regime_dependence_summary(found).first()
    assert total["total_analyzed"] == 2 and total["regime_dependent"] + total["regime_invariant"] == 2
    assert statistics.strongest_regime_effects(found, 1).first()["feature"] == "moved"
    assert statistics.regime_dependence_summary(found.limit(0)).first()["dependence_rate"] == 0.0


def test_audit_of_a_threshold(spark, tmp_path):
    """Bars, features and statistics of one series; the series with too few bars is left out; files are written."""
    from tidemark.operators import rolling
    from tidemark.plans import audit

    rows = [("a", k, 100.0 + 10 * ((k * 7) % 13), 1.0) for k in range(120)] + [("b", k, 100.0, 1.0) for k in range(9)]
    bars = audit.audited_bars(spark.createDataFrame(rows, "series_id string, seq long, price double, quantity double"), 0.01)
    n = bars.filter("series_id = 'a'").count()
    first = bars.filter("series_id = 'a' and seq = 0").first()
    assert n > 20 and first["nav"] == 1.0
    stats = audit.audit_threshold(bars, 10)
    got = stats.collect()
    assert {r["series_id"] for r in got} == {"a"} and len(got) == 8
    assert all(r["n_bars"] == n and r["n_windows"] == n - 9 and r["n_positive"] <= r["n_windows"] and 0 <= r["min"] <= r["max"] <= 1 for r in got)
    audit.write_audit(bars, rolling.rolling_features(bars, (10,)), stats, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/features").count() == bars.count()
    assert spark.read.json(f"{tmp_path}/stats").count() == 8
