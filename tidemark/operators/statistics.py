"""Statistics over the long feature table (series_id, feature, seq, value) and over pairs of its features.

Pairs of features come from a join on (series, seq), so a row meets only the other features of its own
point: work grows with the points times the square of the number of features, which a configuration bounds.
Matrices are p by p, p being that number, and only those are brought to the driver for eigenvalues.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from .spread import average_ranks, counts_below

#: Strips of each axis that a distance correlation's points are cut into at most.
STRIPS = 64
#: Features up to which points are put side by side for their correlations.
WIDE = 32


def pair_correlations(long: DataFrame, method: str = "pearson", keys: tuple[str, ...] = ("series_id", "seq"), least: int = 30) -> DataFrame:
    """(feature_a, feature_b, n, r) for all a < b, over the points at which both have a value; NULL below ``least``.

    Spearman's is Pearson's on average ranks, which are taken over all values of a feature.
    """
    rows = long.filter(F.col("value").isNotNull()).select(*keys, "feature", "value")
    if method == "spearman":
        rows = average_ranks(rows, ["feature"]).withColumn("value", F.col("rank")).drop("rank")
    names = sorted(r.feature for r in rows.select("feature").distinct().limit(WIDE + 1).collect() if r.feature is not None)
    if 1 < len(names) <= WIDE:
        return _wide_correlations(rows, names, keys, least)
    a = rows.withColumnsRenamed({"feature": "feature_a", "value": "x"})
    b = rows.withColumnsRenamed({"feature": "feature_b", "value": "y"})
    met = a.join(b, list(keys)).filter("feature_a < feature_b")
    return met.groupBy("feature_a", "feature_b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def _wide_correlations(rows: DataFrame, names: list[str], keys: tuple[str, ...], least: int) -> DataFrame:
    """``pair_correlations`` of few features: points are put side by side in one shuffle, and all pairs are summed in one pass."""
    columns = [F.max(F.when(F.col("feature") == name, F.col("value").cast("double"))).alias(f"f{i}") for i, name in enumerate(names)]
    wide = rows.groupBy(*keys).agg(*columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: F.count(F.when(F.col(f"f{i}").isNotNull() & F.col(f"f{j}").isNotNull(), F.lit(1)))
    summed = wide.agg(*(F.struct(both(i, j).alias("n"), F.corr(f"f{i}", f"f{j}").alias("r")).alias(f"p{i}_{j}") for i, j in pairs))
    found = [F.struct(F.lit(names[i]).alias("feature_a"), F.lit(names[j]).alias("feature_b"), F.col(f"p{i}_{j}.n").alias("n"), F.col(f"p{i}_{j}.r").alias("r")) for i, j in pairs]
    made = summed.select(F.explode(F.array(*found)).alias("e")).select("e.*").filter("n > 0")
    return made.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def with_target(long: DataFrame, target: DataFrame | None) -> DataFrame:
    """The rows of a long table with their ``target``: as they are if they carry it already, else from (series_id, seq, target)."""
    return long if "target" in long.columns else long.join(target, ["series_id", "seq"])


def correlation_with_target(long: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(feature, r) with a target (series_id, seq, target), or with the ``target`` that the rows carry, which shuffles no rows."""
    return with_target(long, target).groupBy("feature").agg(F.corr("value", "target").alias("r"))


def autocorrelation(long: DataFrame, lags: tuple[int, ...] = (1, 5, 10, 20, 50, 100)) -> DataFrame:
    """(feature, lag, acf), pairwise complete, over each feature's series."""
    order = Window.partitionBy("series_id", "feature").orderBy("seq")
    shifted = long.withColumns({f"lag_{k}": F.lag("value", k).over(order) for k in lags})
    wide = shifted.groupBy("feature").agg(*(F.corr("value", f"lag_{k}").alias(str(k)) for k in lags))
    return wide.unpivot(["feature"], [str(k) for k in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def half_lives(acf: DataFrame) -> DataFrame:
    """(feature, half_life, decorrelated, persistence): first lags below 0.5, and below 0.1 in size, and their class."""
    by = acf.groupBy("feature").agg(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))).alias("half_life"), F.min(F.when(F.abs("acf") < 0.1, F.col("lag"))).alias("decorrelated"))
    return by.withColumn("persistence", F.when(F.col("half_life") <= 5, "low").when(F.col("half_life") <= 20, "medium").otherwise("high"))


def sequence_length(half: DataFrame) -> DataFrame:
    """Suggested sequence length: twice the median half-life within [10, 200]; 50 where no feature has one."""
    median = F.expr("percentile(half_life, 0.5)")
    return half.agg(F.coalesce(F.least(F.greatest((median * 2).cast("int"), F.lit(10)), F.lit(200)), F.lit(50)).alias("length"))


#: Lagged differences of an augmented Dickey-Fuller regression at most. Fixed value of the definition.
MOST_LAGS = 12


def stationarity(long: DataFrame, critical: float = -2.86) -> DataFrame:
    """(series_id, feature, statistic, lags, stationary): t of the lagged level in an augmented Dickey-Fuller regression with a constant.

    Lags number the cube root of the steps, ``MOST_LAGS`` at most. The products of the regression's columns are summed
    by partial aggregates, 15 by 15 numbers a series, and each system of 14 unknowns at most is solved from that one row.
    Levels are taken from the series' mean in units of its deviation, which changes no t. NULL below 50 values,
    nulls left out, or where the level has no spread of its own.
    """
    rows = long.filter(F.col("value").isNotNull()).select("series_id", "feature", "seq", F.col("value").cast("double").alias("value"))
    sizes = rows.groupBy("series_id", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    root = F.pow((F.col("n") - 1).cast("double"), F.lit(1.0 / 3.0))
    whole = F.round(root)
    lags = F.least(F.when(whole * whole * whole == F.col("n") - 1, whole).otherwise(F.floor(root)), F.lit(MOST_LAGS)).cast("int")
    sizes = sizes.withColumn("lags", F.when(F.col("n") >= 50, lags).otherwise(F.lit(0)))
    order = Window.partitionBy("series_id", "feature").orderBy("seq")
    level = F.try_divide(F.col("value") - F.col("mean"), F.col("spread"))
    steps = rows.join(sizes, ["series_id", "feature"]).filter("n >= 50").withColumn("x", level)
    steps = steps.withColumns({"before": F.lag("x").over(order), "at": F.row_number().over(order) - 1}).withColumn("d", F.col("x") - F.col("before"))
    steps = steps.withColumns({f"d{k}": F.when(F.col("lags") >= k, F.lag("d", k).over(order)).otherwise(F.lit(0.0)) for k in range(1, MOST_LAGS + 1)}).filter("at > lags")
    columns = [F.col("before"), F.lit(1.0), *(F.col(f"d{k}") for k in range(1, MOST_LAGS + 1)), F.col("d")]
    sums = F.array(*(F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))))
    summed = steps.groupBy("series_id", "feature", "lags").agg(sums.alias("sums"))

    @F.pandas_udf("double")
    def solved(sums: pd.Series, lags: pd.Series) -> pd.Series:
        return pd.Series([_level_t(np.array(s, np.float64), int(k)) for s, k in zip(sums, lags, strict=True)], dtype="float64")

    found = summed.select("series_id", "feature", solved("sums", "lags").alias("t"))
    known = F.when(~F.isnan("t"), F.col("t"))
    out = sizes.join(found, ["series_id", "feature"], "left").withColumn("statistic", known)
    return out.select("series_id", "feature", "statistic", "lags", (F.col("statistic") < critical).alias("stationary"))


def _level_t(sums: np.ndarray, lags: int) -> float:
    """t of the first column from the upper triangle of all products; NaN where the system can't be solved."""
    p = MOST_LAGS + 3
    products = np.zeros((p, p))
    products[np.triu_indices(p)] = sums
    products += np.triu(products, 1).T
    used = [0, 1, *range(2, 2 + lags)]
    inner, right, n = products[np.ix_(used, used)], products[used, -1], products[1, 1]
    if not np.isfinite(inner).all() or n <= len(used) or np.linalg.matrix_rank(inner) < len(used):
        return float("nan")
    beta = np.linalg.solve(inner, right)
    spread = (products[-1, -1] - 2 * beta @ right + beta @ inner @ beta) / (n - len(used))
    variance = spread * np.linalg.inv(inner)[0, 0]
    return float(beta[0] / math.sqrt(variance)) if variance > 0 else float("nan")


def temporal_structure(long: DataFrame) -> DataFrame:
    """Half-life classes of each feature beside its stationarity."""
    still = stationarity(long).groupBy("feature").agg(F.min(F.col("stationary").cast("int")).alias("stationary"))
    return half_lives(autocorrelation(long)).join(still, "feature", "left")


def rank_effects(long: DataFrame, group: Column, first: str, second: str) -> DataFrame:
    """Of each feature, between two groups: sizes, Mann-Whitney U and p (normal, with ties and continuity), Cliff's delta, Cohen's d.

    ``cliffs_delta`` is 1 - 2U/(n1 n2); ``cliffs_delta_standard`` has the usual sign.
    """
    rows = long.withColumn("g", group).filter(F.col("g").isin(first, second) & F.col("value").isNotNull())
    is1, is2 = F.col("g") == first, F.col("g") == second
    one = lambda c, cond: F.when(cond, c)
    # Rows aren't ranked one by one: equal values are one row with its rank and how many of the first group it has.
    c, distinct = F.col("c"), counts_below(rows, ["feature"], "value", c1=F.count_if(is1))
    ties = distinct.groupBy("feature").agg(F.sum(F.pow(c, 3) - c).alias("ties"), F.sum(F.when(F.col("c1") > 0, F.col("c1") * (F.col("below") + (c + 1) / 2))).alias("ranks"))
    by = rows.groupBy("feature").agg(
        F.count(one(F.lit(1), is1)).cast("double").alias("n1"), F.count(one(F.lit(1), is2)).cast("double").alias("n2"),
        F.avg(one(F.col("value"), is1)).alias("m1"), F.avg(one(F.col("value"), is2)).alias("m2"), F.var_samp(one(F.col("value"), is1)).alias("v1"), F.var_samp(one(F.col("value"), is2)).alias("v2"),
    ).join(ties, "feature")
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    total = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), total - 2))
    delta = 1 - 2 * F.try_divide(u, n1 * n2)
    scored = by.withColumns({"u": u, "cliffs_delta": delta, "cliffs_delta_standard": -delta, "cohens_d": F.try_divide(F.col("m1") - F.col("m2"), pooled), "z": F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), spread)})
    size = F.abs(F.col("cliffs_delta"))
    word = F.when(size < 0.05, "negligible").when(size < 0.15, "small").when(size < 0.30, "medium").otherwise("large")
    return scored.withColumns({"effect": word, "p_value": two_sided_p(F.col("z"))}).select("feature", "n1", "n2", "u", "cliffs_delta", "cliffs_delta_standard", "cohens_d", "effect", "z", "p_value")


def regime_dependence(long: DataFrame, regimes: DataFrame | None = None, least: int = 30) -> DataFrame:
    """Each feature of a long table in trending, mean-reverting and random regimes (series_id, seq, regime): sizes, means and
    deviations, the effect between the first two and whether the feature depends on the regime (p below 0.05).

    Without ``regimes``, rows carry their ``regime``, and none are joined. Features with fewer than ``least`` values in either of the two have an ``error`` and no effects.
    """
    rows = long.filter(F.col("value").isNotNull())
    rows = rows if regimes is None else rows.join(regimes.select("series_id", "seq", "regime"), ["series_id", "seq"])
    within = {"trending": "trending", "mean_rev": "mean_reverting", "random": "random"}
    of = {k: F.when(F.col("regime") == v, F.col("value")) for k, v in within.items()}
    sizes = [F.count(c).alias(f"n_{k}") for k, c in of.items()]
    by = rows.groupBy("feature").agg(*sizes, *(f(c).alias(f"{k}_{n}") for k, c in of.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    named = F.when(F.col("effect") == "small", "small_tradable").when(F.col("effect") == "medium", "medium_strong").when(F.col("effect") == "large", "large_suspicious").otherwise(F.col("effect"))
    effects = rank_effects(rows, F.col("regime"), "trending", "mean_reverting").withColumn("effect", named).select("feature", "u", "z", "p_value", "cohens_d", "cliffs_delta", "effect")
    enough = (F.col("n_trending") >= least) & (F.col("n_mean_rev") >= least)
    short = F.format_string("Insufficient samples (trending=%d, mean_rev=%d)", "n_trending", "n_mean_rev")
    met = by.join(effects, "feature", "left").withColumn("regime_dependent", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    scored = {c: F.when(enough, F.col(c)) for c in met.columns if c not in ("feature", "n_trending", "n_mean_rev", "n_random")}
    return met.withColumns({**scored, "error": F.when(~enough, short)})


def regime_dependence_summary(dependence: DataFrame) -> DataFrame:
    """One row: features analysed, dependent and invariant ones, the rate, and how many there are of each size of effect."""
    valid = dependence.filter("error is null")
    sizes = ("negligible", "small_tradable", "medium_strong", "large_suspicious")
    counted = valid.agg(F.count(F.lit(1)).alias("total_analyzed"), F.count_if("regime_dependent").alias("regime_dependent"), *(F.count_if(F.col("effect") == s).alias(s) for s in sizes))
    total, dependent = F.col("total_analyzed"), F.col("regime_dependent")
    return counted.select(total, dependent, (total - dependent).alias("regime_invariant"), F.coalesce(F.try_divide(dependent, total), F.lit(0.0)).alias("dependence_rate"), *sizes)


def strongest_regime_effects(dependence: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` dependent features with the largest Cliff's delta either way; ties go to the name that sorts first."""
    strong = dependence.filter("error is null and regime_dependent")
    return strong.orderBy(F.desc(F.abs("cliffs_delta")), "feature").limit(n).select("feature", "cliffs_delta", "cohens_d", "p_value")


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of erfc (Abramowitz and Stegun 7.1.26), good to 2e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(c)) * t
    return poly * F.exp(-x * x)


def regime_counts(labels: DataFrame, label: str = "regime") -> DataFrame:
    n = F.count(F.lit(1))
    return labels.groupBy("series_id", label).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def _rescaled_ranges(windows: np.ndarray) -> np.ndarray:
    """Exponent of rescaled ranges over growing blocks for each window (row), within [0, 1]; 0.5 where it can't be told."""
    rows, n = windows.shape
    if n < 20:
        return np.full(rows, 0.5)
    top = min(n // 2, 100)
    sizes = range(10, top + 1, max(1, top // 20))
    logs = np.full((rows, len(sizes)), np.nan)
    for c, k in enumerate(sizes):
        blocks = windows[:, : n // k * k].reshape(rows, -1, k)
        path = np.cumsum(blocks - blocks.mean(2, keepdims=True), axis=2)
        span, std = path.max(2) - path.min(2), blocks.std(2, ddof=1)
        seen = std > 0
        ratio = np.where(seen, span / np.where(seen, std, 1), 0).sum(1) / np.maximum(seen.sum(1), 1)
        logs[:, c] = np.where(ratio > 0, np.log(np.where(ratio > 0, ratio, 1)), np.nan)
    known = ~np.isnan(logs)
    count = known.sum(1)
    x = np.where(known, np.log(np.array(sizes, float)), 0)
    y = np.where(known, logs, 0)
    xm, ym = x.sum(1) / np.maximum(count, 1), y.sum(1) / np.maximum(count, 1)
    dx = np.where(known, x - xm[:, None], 0)
    spread = (dx * dx).sum(1)
    slope = (dx * (y - ym[:, None])).sum(1) / np.where(spread > 0, spread, 1)
    return np.where(count >= 3, np.clip(slope, 0, 1), 0.5)


def detect_regime(nav: DataFrame, lookback: int = 100, chunk: int = 2048) -> DataFrame:
    """(series_id, seq, hurst, regime) from the ``lookback`` points before each, the point itself not among them.

    Chunks carry the points before them, so a long series is many tasks.
    """
    own, until = F.floor(F.col("seq") / chunk).cast("long"), F.floor((F.col("seq") + lookback) / chunk).cast("long")
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy("series_id")) - 1) / chunk).cast("long")
    dealt = nav.select("series_id", "seq", F.col("nav").cast("double").alias("nav"), last.alias("last")).withColumn("chunk", F.explode(F.sequence(own, F.least(until, F.col("last")))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, seq = pdf["nav"].to_numpy(), pdf["seq"].to_numpy()
        hurst = np.full(len(x), np.nan)
        if len(x) > lookback:
            hurst[lookback:] = _rescaled_ranges(np.lib.stride_tricks.sliding_window_view(x, lookback)[:-1])
        out = pd.DataFrame({"series_id": pdf["series_id"], "seq": seq, "hurst": hurst})
        return out[seq >= int(pdf["chunk"].iloc[0]) * chunk]

    found = dealt.groupBy("series_id", "chunk").applyInPandas(run, "series_id string, seq long, hurst double")
    known = F.col("hurst").isNotNull() & ~F.isnan("hurst")
    word = F.when(~known, "warmup").when(F.col("hurst") > 0.55, "trending").when(F.col("hurst") < 0.45, "mean_reverting").otherwise("random")
    return found.withColumns({"regime": word, "hurst": F.when(known, F.col("hurst"))})


def correlation_matrix(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The feature names and their correlation matrix; pairs number p (p - 1) / 2 for p features of a configuration."""
    rows = pairs.select("feature_a", "feature_b", "r").collect()
    names = sorted({x for r in rows for x in r[:2]})
    at, m = {f: i for i, f in enumerate(names)}, np.eye(len(names))
    for a, b, r in rows:
        m[at[a], at[b]] = m[at[b], at[a]] = r if r is not None else 0.0
    return names, m


def participation_ratio(pairs: DataFrame) -> DataFrame:
    """Effective number of dimensions: p squared over the sum of squared correlations."""
    p = F.lit(1) + F.max("width")
    width = pairs.groupBy("feature_a").agg(F.count(F.lit(1)).alias("width"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    return width.agg((p * p / (p + 2 * F.sum("ss"))).alias("participation_ratio"), p.alias("n_features"))


def pca(pairs: DataFrame) -> dict:
    """Shares of variance, components for 90, 95 and 99 percent, and the five largest loadings of each."""
    names, m = correlation_matrix(pairs)
    value, vector = np.linalg.eigh(m)
    order = np.argsort(value)[::-1]
    share = np.clip(value[order], 0, None) / max(value.sum(), 1e-300)
    cumulative = np.cumsum(share)
    top = [[names[i] for i in np.argsort(-np.abs(vector[:, k]))[:5]] for k in order[:5]]
    return {"shares": share.tolist(), "components": {q: int(np.searchsorted(cumulative, q - 1e-12) + 1) for q in (0.90, 0.95, 0.99)}, "top": top}


def variance_inflation(pairs: DataFrame, target_condition: float = 100.0) -> dict[str, float]:
    """Diagonal of the inverse of the correlation matrix, ridged until its condition is ``target_condition``."""
    names, m = correlation_matrix(pairs)
    value = np.linalg.eigvalsh(m)
    ridge = max(0.0, (value[-1] - target_condition * value[0]) / (target_condition - 1)) if value[0] > 0 else max(0.01, (value[-1] - target_condition * value[0]) / (target_condition - 1))
    return dict(zip(names, np.diag(np.linalg.inv(m + ridge * np.eye(len(m)))).tolist(), strict=True))


def normality(described: DataFrame) -> DataFrame:
    """D'Agostino's K squared from skew and excess kurtosis of ``describe``, with its chi-square tail at two degrees."""
    n, s, k = F.col("n").cast("double"), F.col("skew"), F.col("kurtosis")
    y = s * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt(F.pow(y / alpha, 2) + 1))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (k + 3 - mean) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    term = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(term) * F.pow(F.abs(term), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return described.withColumns({"k2": F.when(n >= 20, k2), "p_value": F.when(n >= 20, F.exp(-k2 / 2))})


def beta_moments(described: DataFrame) -> DataFrame:
    """Parameters of a Beta distribution on [0, 1] with a feature's mean and variance; NULL where there is none."""
    m, v = F.col("mean"), F.col("std") * F.col("std")
    common = F.try_divide(m * (1 - m), v) - 1
    good = (m > 0) & (m < 1) & (common > 0)
    return described.withColumns({"alpha": F.when(good, m * common), "beta": F.when(good, (1 - m) * common)})


def threshold_stability(long: DataFrame) -> DataFrame:
    """(lookback, feature, cv, spread, stable): how much a feature's mean moves across thresholds."""
    means = long.filter(F.col("value").isNotNull()).groupBy("threshold_dbps", "lookback", "feature").agg(F.avg("value").alias("mean"))
    by = means.groupBy("lookback", "feature").agg(F.count(F.lit(1)).alias("n_thresholds"), F.try_divide(F.stddev_pop("mean"), F.avg("mean")).alias("cv"), (F.max("mean") - F.min("mean")).alias("spread"))
    return by.withColumn("stable", F.coalesce(F.col("cv") < 0.20, F.lit(False)))


def _products_below(place: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point, the sum of w (X - x) (Y - y) over the points with a smaller place and a smaller y.

    Two places part at one bit. There, running sums by y over the points with that bit unset are read by the others; ties add nothing.
    """
    order = np.argsort(y, kind="stable")
    place, x, y, w = place[order], x[order], y[order], w[order]
    found = np.zeros(len(x))
    for level in range(int(place.max()).bit_length()):
        block = place >> (level + 1)
        by = np.argsort(block, kind="stable")
        bit, first = place[by] >> level & 1, np.searchsorted(block[by], block[by])
        low = np.where(bit == 0, w[by], 0.0)
        c, sx, sy, sxy = ((t := np.r_[0.0, np.cumsum(low * v)])[1:] - t[first] for v in (1.0, x[by], y[by], x[by] * y[by]))
        found[by] += np.where(bit == 1, c * x[by] * y[by] - x[by] * sy - y[by] * sx + sxy, 0.0)
    out = np.empty(len(x))
    out[order] = found
    return out


def _distances_within(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each value, the sum of w |X - x| over all."""
    order = np.argsort(x, kind="stable")
    c, s = np.cumsum(w[order]), np.cumsum(w[order] * x[order])
    out = np.empty(len(x))
    out[order] = x[order] * (2 * c - c[-1]) + s[-1] - 2 * s
    return out


def distance_correlation(pairs: DataFrame, keys: tuple[str, ...] = ("feature_a", "feature_b"), rows: int = 20_000) -> DataFrame:
    """(keys, n, dcor) of rows (keys, x, y), exact over all points of a group without its n by n distances.

    Equal points are one row with a weight. A group is cut into up to ``STRIPS`` strips by x and as many by y, of about ``rows``
    points at least. A point's distances to all others are sums over the strips below and above, and those within its own. The sum
    of products of distances needs, for each point, sums over the points below it on both axes (Huo and Szekely, 2016): these lie in a
    cell of a lower strip on both axes, in its own strip by x, or in a lower strip by x and its own by y. So each distinct point
    is shuffled three times, whatever n is. A strip of one value, in which no distances are, is dealt out by a salt.

    Points without a finite x and y are left out; a group without spread in x or y has 0; one of such points only is absent.
    Keys aren't null.
    """
    both = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in ("x", "y")]
    whole = pairs.filter(both[0] & both[1]).select(*keys, *(F.col(c).cast("double").alias(c) for c in ("x", "y")))
    points = written(whole.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    cuts = [k / STRIPS for k in range(1, STRIPS)]
    made = {f"{k}_{c}": f for c in ("x", "y") for k, f in {"mean": F.sum(F.col("w") * F.col(c)) / F.sum("w"), "least": F.min(c), "most": F.max(c), "cuts": F.percentile_approx(c, cuts)}.items()}
    sizes = written(points.groupBy(*keys).agg(F.sum("w").cast("long").alias("n"), F.count(F.lit(1)).alias("points"), *(f.alias(k) for k, f in made.items())))
    step = F.ceil(F.lit(STRIPS * rows) / F.col("points")).cast("int")
    bounds = sizes.withColumns({f"cuts_{c}": F.array_distinct(F.filter(f"cuts_{c}", lambda v, i: (i + 1) % step == 0)) for c in ("x", "y")})

    def strip_of(c: str) -> Column:
        return F.size(F.filter(f"cuts_{c}", lambda b: b <= F.col(c)))

    placed = points.join(F.broadcast(bounds), list(keys)).select(
        *keys, "w", *(strip_of(c).alias(f"strip_{c}") for c in ("x", "y")),
        *(F.when(F.col(f"least_{c}") < F.col(f"most_{c}"), F.col(c) - F.col(f"mean_{c}")).otherwise(0.0).alias(c) for c in ("x", "y")),
    )
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = {"c": w, "x1": w * x, "y1": w * y, "xy": w * x * y, "x2": w * x * x, "y2": w * y * y}
    cells = written(placed.groupBy(*keys, "strip_x", "strip_y").agg(F.count(F.lit(1)).alias("points"), *(F.sum(v).alias(k) for k, v in sums.items()), *(f(c).alias(f"{k}_{c}") for c in ("x", "y") for k, f in (("least", F.min), ("most", F.max)))))

    def strips(c: str) -> DataFrame:
        """What the strips before and after each strip of an axis add up to, and how many salts it has."""
        own = cells.groupBy(*keys, f"strip_{c}").agg(F.sum("points").alias("points"), F.sum("c").alias("own_c"), F.sum(f"{c}1").alias("own_s"), F.min(f"least_{c}").alias("low"), F.max(f"most_{c}").alias("high"))
        before = Window.partitionBy(*keys).orderBy(f"strip_{c}").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy(f"strip_{c}").rowsBetween(1, Window.unboundedFollowing)
        outer = {f"{k}_{e}": F.coalesce(F.sum(f"own_{e}").over(by), F.lit(0.0)) for k, by in (("before", before), ("after", after)) for e in ("c", "s")}
        salts = F.when(F.col("low") == F.col("high"), F.ceil(F.col("points") / (5 * rows))).otherwise(1)
        return F.broadcast(own.select(*keys, f"strip_{c}", salts.alias("salts"), *(v.alias(k) for k, v in outer.items())))

    def dealt(df: DataFrame, c: str, other: str, name: str) -> DataFrame:
        outer = F.col(c) * (F.col("before_c") - F.col("after_c")) - F.col("before_s") + F.col("after_s")
        met = df.join(strips(c), [*keys, f"strip_{c}"]).withColumns({name: outer, "salt": F.pmod(F.xxhash64(other), F.col("salts"))})
        return met.drop("salts", "before_c", "before_s", "after_c", "after_s")

    def by_x(pdf: pd.DataFrame) -> pd.DataFrame:
        x_, y_, w_ = (pdf[c].to_numpy() for c in ("x", "y", "w"))
        place = np.empty(len(pdf), np.int64)
        place[np.argsort(x_, kind="stable")] = np.arange(len(pdf))
        out = pdf.drop(columns=["salt"])
        out["u"] += _distances_within(x_, w_)
        out["under"] = _products_below(place, x_, y_, w_)
        return out

    def by_y(pdf: pd.DataFrame) -> pd.DataFrame:
        x_, y_, w_, u = (pdf[c].to_numpy() for c in ("x", "y", "w", "u"))
        v = pdf["v"].to_numpy() + _distances_within(y_, w_)
        under = pdf["under"].to_numpy() + _products_below(pdf["strip_x"].to_numpy().astype(np.int64), x_, y_, w_)
        terms = {"under": under, "u1": u, "v1": v, "u2": u * u, "v2": v * v, "uv": u * v}
        return pdf[list(keys)].head(1).assign(**{k: float((w_ * t).sum()) for k, t in terms.items()})

    def by_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        def below(c: str) -> np.ndarray:
            table = np.zeros((STRIPS + 1, STRIPS + 1))
            at_x, at_y = pdf["strip_x"].to_numpy(), pdf["strip_y"].to_numpy()
            table[at_x + 1, at_y + 1] = pdf[c]
            return table.cumsum(0).cumsum(1)[at_x, at_y]

        under = pdf["xy"] * below("c") - pdf["x1"] * below("y1") - pdf["y1"] * below("x1") + pdf["c"] * below("xy")
        return pdf[list(keys)].head(1).assign(under=float(under.sum()), **dict.fromkeys(("u1", "v1", "u2", "v2", "uv"), 0.0))

    kinds = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys)
    in_x = dealt(placed, "x", "y", "u").groupBy(*keys, "strip_x", "salt").applyInPandas(by_x, kinds + ", strip_x int, w double, strip_y int, x double, y double, u double, under double")
    result = kinds + ", under double, u1 double, v1 double, u2 double, v2 double, uv double"
    in_y = dealt(in_x, "y", "x", "v").groupBy(*keys, "strip_y", "salt").applyInPandas(by_y, result)
    parts = in_y.unionByName(cells.groupBy(*keys).applyInPandas(by_cell, result))
    plain = cells.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in sums if k != "c"))
    summed = parts.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in ("under", "u1", "v1", "u2", "v2", "uv"))).join(plain, list(keys)).join(sizes.select(*keys, "n"), list(keys))
    n = F.col("n").cast("double")

    def covariance(products: Column, one: str, two: str, rows_: str) -> Column:
        return products / n / n + F.col(one) / n / n * (F.col(two) / n / n) - 2 * F.col(rows_) / n / n / n

    of_x = covariance(2 * (n * F.col("x2") - F.col("x1") * F.col("x1")), "u1", "u1", "u2")
    of_y = covariance(2 * (n * F.col("y2") - F.col("y1") * F.col("y1")), "v1", "v1", "v2")
    of_xy = covariance(4 * F.col("under") - 2 * (n * F.col("xy") - F.col("x1") * F.col("y1")), "u1", "v1", "uv")
    spread = F.sqrt(F.greatest(of_x * of_y, F.lit(0.0)))
    return summed.select(*keys, "n", F.when(spread > 0, F.sqrt(F.greatest(of_xy, F.lit(0.0)) / spread)).otherwise(0.0).alias("dcor"))
