"""Tests of a feature's distribution: Shapiro-Wilk, and Anderson-Darling against a fitted Beta with a simulated null.

Samples are sorted by ranges (``spread``), so a feature of any length has no task of its own; the Beta is fitted from two
summed logarithms; and each replicate of the null is a row of its own.
"""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import counts_below

#: Rows of a feature that Shapiro-Wilk takes. Fixed value of the definition.
SHAPIRO_ROWS = 5000
#: W from which a sample is called so. Fixed values of the definition.
GAUSSIANITY = {"practically_normal": 0.99, "minor_departures": 0.95, "moderate_non_normality": 0.90}
#: Values are kept so far from 0 and 1. Fixed value of the definition.
EDGE = 1e-10
#: Values of a replicate at most; beyond a few hundred the statistic's distribution no longer depends on their number.
REPLICATE_ROWS = 500


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p by Royston's approximation (1995) for 4 to 5,000 values; NaN for a constant."""
    x, n = np.sort(x), len(x)
    if n < 4 or x[-1] - x[0] <= 1e-12 * max(1.0, abs(x[-1])):
        return math.nan, math.nan
    inverse = NormalDist().inv_cdf
    m = np.array([inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, u = float(m @ m), 1 / math.sqrt(n)
    a = m.copy()
    # Fixed values of the approximation: polynomials in 1 / sqrt(n) of the two outer weights.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ssq)], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ssq)], u)
        a /= math.sqrt((ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[[0, 1, -2, -1]] = -last, -second, second, last
    else:
        a /= math.sqrt((ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[0, -1]] = -last, last
    off = x - x.mean()
    w = min(float((a @ x) ** 2 / (off @ off)), 1.0)
    if w == 1.0:
        return w, 1.0
    # Fixed values of the approximation: mean and deviation of the transformed statistic.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if gamma <= math.log(1 - w):
            return w, 0.0
        y, mean, deviation = -math.log(gamma - math.log(1 - w)), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, mean, deviation = math.log(1 - w), np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n)), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2))


def shapiro(long: DataFrame) -> DataFrame:
    """(feature, shapiro_w, shapiro_p, gaussianity) of the first ``SHAPIRO_ROWS`` values of each feature by (series_id, seq).

    NULL and ``unknown`` below 10 values or without spread. No more than those rows of a series, nor of a feature, meet in a task.
    """
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", "series_id", "seq", F.col("value").cast("double").alias("value"))
    head = F.row_number().over(Window.partitionBy("feature", "series_id").orderBy("seq"))
    few = rows.withColumn("k", head).filter(F.col("k") <= SHAPIRO_ROWS)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("series_id", "seq"))).filter(F.col("k") <= SHAPIRO_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy()) if len(pdf) >= 10 else (math.nan, math.nan)
        word = next((k for k, least in GAUSSIANITY.items() if w > least), "substantial_non_normality") if w == w else "unknown"
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "shapiro_w": [w], "shapiro_p": [p], "gaussianity": [word]})

    found = first.groupBy("feature").applyInPandas(run, "feature string, shapiro_w double, shapiro_p double, gaussianity string")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("shapiro_w", "shapiro_p")})


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive x, by recurrence to 12 and beyond and the asymptotic series."""
    x, out = np.asarray(x, np.float64).copy(), np.zeros(np.shape(x))
    for _ in range(12):
        out, x = out - np.where(x < 12, 1 / x, 0), np.where(x < 12, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma`` for positive x."""
    x, out = np.asarray(x, np.float64).copy(), np.zeros(np.shape(x))
    for _ in range(12):
        out, x = out + np.where(x < 12, 1 / (x * x), 0), np.where(x < 12, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def beta_fit(log_x: np.ndarray, log_y: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely parameters of Beta distributions with these mean logarithms of x and 1 - x, by Newton steps from the moments."""
    common = np.maximum(mean * (1 - mean) / np.maximum(variance, 1e-300) - 1, 1e-3)
    a, b = np.maximum(mean * common, 1e-3), np.maximum((1 - mean) * common, 1e-3)
    for _ in range(60):
        both = digamma(a + b)
        fa, fb = digamma(a) - both - log_x, digamma(b) - both - log_y
        ta, tb, tc = trigamma(a), trigamma(b), trigamma(a + b)
        det = ta * tb - tc * (ta + tb)
        da, db = (fa * (tb - tc) + fb * tc) / det, (fb * (ta - tc) + fa * tc) / det
        a, b = np.maximum(a - da, a / 10), np.maximum(b - db, b / 10)
        if np.all(np.abs(da) < 1e-12 * a) and np.all(np.abs(db) < 1e-12 * b):
            break
    return a, b


_log_gamma = np.vectorize(math.lgamma, otypes=[np.float64])


def beta_cdf(x: np.ndarray, a: float | np.ndarray, b: float | np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, from whichever side converges (Lentz's method)."""
    x, a, b = np.asarray(x, np.float64), np.asarray(a, np.float64), np.asarray(b, np.float64)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + p * np.log(np.maximum(z, 1e-300)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    return np.where(flip, 1 - front * h, front * h)


def anderson_darling(x: np.ndarray, a: float | np.ndarray, b: float | np.ndarray) -> np.ndarray:
    """The statistic of sorted values (along the last axis) against Beta(a, b)."""
    n, f = x.shape[-1], np.clip(beta_cdf(x, a, b), 1e-300, 1 - 1e-16)
    i = np.arange(1, n + 1)
    return -n - ((2 * i - 1) * (np.log(f) + np.log1p(-f[..., ::-1]))).sum(-1) / n


def _replicates(a: np.ndarray, b: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """The statistics of n values each, drawn from Beta(a, b) by these seeds, against the Betas fitted to them."""
    drawn = np.stack([np.random.default_rng(int(s)).beta(p, q, n) for p, q, s in zip(a, b, seeds, strict=True)])
    x = np.sort(np.clip(drawn, EDGE, 1 - EDGE), axis=1)
    fa, fb = beta_fit(np.log(x).mean(1), np.log1p(-x).mean(1), x.mean(1), x.var(1))
    return anderson_darling(x, fa[:, None], fb[:, None])


def beta_goodness(long: DataFrame, first: int = 99, second: int = 999, seed: int = 42) -> DataFrame:
    """(feature, n, alpha, beta, ad_statistic, ad_p_value, fits_well, stage_used) of values in [0, 1] against their most likely Beta.

    p is the share of replicates, drawn from the fit and fitted again, whose statistic is as large, with the sample itself
    among them. ``first`` replicates are drawn, and ``second`` where these give a p between 0.001 and 0.1. A replicate has
    as many values as the feature, ``REPLICATE_ROWS`` at most. NULL below 10 values or without spread; values beyond
    [0, 1] count as its ends.
    """
    x = F.least(F.greatest(F.col("value").cast("double"), F.lit(EDGE)), F.lit(1 - EDGE))
    rows = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", x.alias("x"))
    sums = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log("x")).alias("lx"), F.avg(F.log1p(-F.col("x"))).alias("ly"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))

    @F.pandas_udf("alpha double, beta double")
    def fitted(lx: pd.Series, ly: pd.Series, m: pd.Series, v: pd.Series) -> pd.DataFrame:
        a, b = beta_fit(*(s.to_numpy(np.float64) for s in (lx, ly, m, v)))
        return pd.DataFrame({"alpha": a, "beta": b})

    fits = sums.filter("n >= 10 and v > 0").select("feature", "n", fitted("lx", "ly", "m", "v").alias("f")).select("feature", "n", "f.*")

    @F.pandas_udf("lower double, upper double")
    def logs(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(x), 2))
        for pair in set(zip(a, b, strict=True)):
            at = ((a == pair[0]) & (b == pair[1])).to_numpy()
            f = np.clip(beta_cdf(x[at].to_numpy(), *pair), 1e-300, 1 - 1e-16)
            out[at] = np.column_stack([np.log(f), np.log1p(-f)])
        return pd.DataFrame(out, columns=["lower", "upper"])

    # Equal values share a row: the i-th smallest of c of them have i from below + 1 to below + c, and 2i - 1 sums to c (2 below + c).
    ranked = counts_below(rows, ["feature"], "x").drop("n").join(fits, "feature").withColumn("l", logs("x", "alpha", "beta"))
    c, below, n = F.col("c"), F.col("below"), F.col("n")
    weighed = c * (2 * below + c) * F.col("l.lower") + c * (2 * (n - below - c) + c) * F.col("l.upper")
    tested = fits.join(ranked.groupBy("feature").agg((-F.max(n) - F.sum(weighed) / F.max(n)).alias("ad_statistic")), "feature")

    @F.pandas_udf("double")
    def drawn(a: pd.Series, b: pd.Series, n: pd.Series, seeds: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for size in sorted(set(n)):
            at = np.flatnonzero(n.to_numpy() == size)
            for i in range(0, len(at), 64):
                part = at[i : i + 64]
                out[part] = _replicates(a.to_numpy()[part], b.to_numpy()[part], int(size), seeds.to_numpy()[part])
        return pd.Series(out)

    def stage(these: DataFrame, replicates: int) -> DataFrame:
        spread = these.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).repartition("feature", "k")
        one = drawn("alpha", "beta", F.least("n", F.lit(REPLICATE_ROWS)), F.pmod(F.xxhash64(F.lit(seed), F.lit(replicates), "feature", "k"), F.lit(1 << 31)))
        counted = spread.withColumn("as_large", (one >= F.col("ad_statistic")).cast("int")).groupBy("feature").agg(F.sum("as_large").alias("as_large"))
        return counted.select("feature", ((F.col("as_large") + 1) / (replicates + 1)).alias(f"p_{replicates}"))

    one = tested.join(stage(tested, first), "feature")
    doubtful = one.filter((F.col(f"p_{first}") > 0.001) & (F.col(f"p_{first}") < 0.10))
    both = one.join(stage(doubtful, second), "feature", "left")
    p = F.coalesce(f"p_{second}", f"p_{first}")
    found = both.select("feature", "alpha", "beta", "ad_statistic", p.alias("ad_p_value"), (p > 0.05).alias("fits_well"), F.when(F.col(f"p_{second}").isNotNull(), 2).otherwise(1).alias("stage_used"))
    return sums.select("feature", "n").join(found, "feature", "left")
