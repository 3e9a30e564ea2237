"""Scalar functions as Column expressions; all run inside generated code, none as a UDF.

Undefined results are NULL. Divisions use ``try_divide`` so that ANSI mode never raises on a zero; ratios of a series'
own values use ``divided``, where a value of zero counts as the number it is.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The double's machine epsilon, and factors of the bounded features' maps.
EPS = 2.220446049250313e-16
MAD_TO_STD = 1.4826
MINIMUM_SAMPLES = {"hurst": 256, "sample_entropy": {1: 50, 2: 200, 3: 1000}, "per_bin": 10, "per_pattern": 10}


def divided(a: Column, b: Column) -> Column:
    """Quotient of doubles by IEEE rules: a zero divisor gives an infinity, or NaN for a zero over it; NULL for a NULL."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def relative_epsilon(x: Column) -> Column:
    return F.greatest(F.abs(x), F.lit(1.0)) * F.lit(EPS * 100)


def logistic_sigmoid(x: Column, centre: float | Column, slope: float) -> Column:
    c = centre if isinstance(centre, Column) else F.lit(float(centre))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - c) * F.lit(float(slope))))


def normalize_epochs(epochs: Column, lookback: Column | int) -> Column:
    """Epoch density as a sigmoid about one epoch in two points; a lookback of 0 gives 0.5."""
    n = lookback if isinstance(lookback, Column) else F.lit(lookback)
    return F.when(n == 0, F.lit(0.5)).otherwise(logistic_sigmoid(F.try_divide(epochs.cast("double"), n.cast("double")), 0.5, 10.0))


def normalize_excess(v: Column) -> Column:
    return F.tanh(F.abs(v) * F.lit(5.0))


def normalize_cv(cv: Column) -> Column:
    """A missing coefficient of variation counts as 0, whose image is 0.1192."""
    return logistic_sigmoid(F.coalesce(F.when(~F.isnan(cv), cv), F.lit(0.0)), 0.5, 4.0)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


normalize_drawdown = normalize_runup = clamp01


def ohlc_is_valid(o: Column, h: Column, low: Column, c: Column) -> Column:
    """Highs above all else, lows below all else, and all positive and finite."""
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) for x in (o, h, low, c)]
    ok = (h >= low) & (h >= o) & (h >= c) & (low <= o) & (low <= c)
    for f in finite:
        ok = f & ok
    return F.coalesce(ok, F.lit(False))


def garman_klass_raw(o: Column, h: Column, low: Column, c: Column) -> Column:
    """Range volatility of a bar; NULL for a price that is not positive, or a high below the low."""
    good = (o > 0) & (h > 0) & (low > 0) & (c > 0) & (h >= low)
    hl, co = F.log(F.try_divide(F.when(good, h), low)), F.log(F.try_divide(F.when(good, c), o))
    return F.when(good, F.sqrt(F.greatest(F.lit(0.0), F.lit(0.5) * hl * hl - F.lit(2 * 0.6931471805599453 - 1) * co * co)))


def garman_klass(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.tanh(garman_klass_raw(o, h, low, c) * F.lit(10.0))


def garman_klass_with_stats(raw: Column, mean: Column, std: Column) -> Column:
    return logistic_sigmoid((raw - mean) / F.greatest(std, F.lit(EPS)), 0.0, 1.0)


def hurst_soft_clamp(x: Column) -> Column:
    return F.lit(0.5) + F.lit(0.5) * F.tanh((x - F.lit(0.5)) * F.lit(4.0))


def hurst_adaptive(raw: Column, history: Column | None = None) -> Column:
    """Raw exponent scaled by the spread of a history (an array of at least four), else by 0.25."""
    scale = F.lit(0.25)
    if history is not None:
        s, n = F.array_sort(history), F.size(history)
        iqr = F.try_element_at(s, (F.floor(n * 3 / 4) + 1).cast("int")) - F.try_element_at(s, (F.floor(n / 4) + 1).cast("int"))
        scale = F.when(n >= 4, F.greatest(iqr, F.lit(0.1))).otherwise(scale)
    return logistic_sigmoid((raw - F.lit(0.5)) / (F.lit(2.0) * scale), 0.0, 1.0)


def embedding_dimension(n: Column, at_most: int = 7) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(3)), F.lit(max(at_most, 3)))


def log_spaced_windows(least: Column, most: Column, k: int) -> Column:
    """``k`` window sizes spaced evenly in the logarithm, halves rounded up; only the least where they meet."""
    low = F.greatest(least, F.lit(4)).cast("double")
    ratio = F.log(most / low)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(max(1, k - 1))), lambda i: F.floor(low * F.exp(ratio * i / F.lit(float(max(1, k - 1)))) + F.lit(0.5)).cast("int"))
    return F.when((most <= low) | (F.lit(k) < 2), F.array(low.cast("int"))).otherwise(sizes)


def adaptive_windows(n: Column, k: int, share: int = 100) -> Column:
    """Window sizes for a length: from ten, or one part in ``share`` of it, to a quarter of it."""
    least = F.greatest(F.lit(10), F.floor(n / F.lit(share)).cast("int"))
    most = F.least(F.greatest(F.floor(n / F.lit(4)).cast("int"), least + 1), n.cast("int")).cast("double")
    return log_spaced_windows(least, most, k)


def fluctuation_windows(n: Column, k: int) -> Column:
    return adaptive_windows(n, k, share=50)


def minimum_permutation_samples(m: int) -> int:
    out = MINIMUM_SAMPLES["per_pattern"]
    for k in range(2, m + 1):
        out *= k
    return out


def adaptive_tolerance(condition: Column, n: Column) -> Column:
    return condition * F.sqrt(n.cast("double")) * F.lit(EPS * 10)


def first_digits(num: Column, k: int = 12) -> Column:
    """The first ``k`` digits of a number's text, without zeros, points and signs in it, padded with zeros."""
    return F.rpad(F.substring(F.regexp_replace(num.cast("string"), r"[0.\-]", ""), 1, k), k, "0")


def feature_name(threshold: Column, lookback: Column, code: Column) -> Column:
    return F.format_string("ith_rb%d_lb%d_%s", threshold, lookback, code)


def epoch_millis(v: Column) -> Column:
    """Milliseconds of a stamp that is in nanoseconds if it is beyond 1e15; divided as integers, toward zero, since doubles hold no nanoseconds of today."""
    return F.when(F.abs(v) > F.lit(10**15), F.call_function("div", v.cast("long"), F.lit(1_000_000))).otherwise(v.cast("long"))


def millis(us: Column) -> Column:
    """Milliseconds of a stamp in microseconds, toward zero: ``epoch_millis`` of its nanoseconds where these tell their unit and fit a long."""
    told = (F.abs(us) > F.lit(10**12)) & (F.abs(us) <= F.lit((2**63 - 1) // 1000))
    return F.when(told, epoch_millis(us * F.lit(1000))).otherwise(F.call_function("div", us, F.lit(1000)))


def cache_key(symbol: Column, threshold: Column, start: Column, end: Column, mode: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", symbol, threshold, start, end, mode), 256), 1, 16)


def has_feature(versions: Column, name: str, minimum: str, lexicographic: bool = False) -> Column:
    """Whether a JSON map of versions has ``name`` at ``minimum`` or later, compared by number or by text."""
    own = F.get_json_object(versions, f"$.{name}")
    if lexicographic:
        return F.coalesce(own >= F.lit(minimum), F.lit(False))
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.coalesce(parts(own) >= parts(F.lit(minimum)), F.lit(False))


def all_bounded(*values: Column) -> Column:
    """Whether all values are numbers in [0, 1]; a missing one or NaN is not."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce((v >= 0.0) & (v <= 1.0) & ~F.isnan(v), F.lit(False))
    return ok


# The continuity tolerances that presets stand for, as fractions.
TOLERANCES = {"permissive": 0.05, "research": 0.02, "standard": 0.01, "strict": 0.005, "paranoid": 0.001}


def effective_tolerance(preset: Column, tolerance: Column) -> Column:
    """The stated tolerance, or else the preset's; NULL for an unknown preset."""
    known = F.lit(None).cast("double")
    for name, value in TOLERANCES.items():
        known = F.when(preset == name, F.lit(value)).otherwise(known)
    return F.coalesce(tolerance.cast("double"), known)


def warmup_bars(lookbacks: Column) -> Column:
    """Bars before the first full window of the longest of an array of lookbacks."""
    return F.array_max(lookbacks) - 1
