"""Lengths of bootstrap blocks, and importances over resampled blocks (Politis and White, 2004; corrected by Patton and others, 2009)."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .spread import running_sums
from .statistics import with_target

#: Points of a chunk whose lagged products are summed together.
CHUNK = 1 << 16
#: A lag's correlation counts from so many roots of log10(n) / n. Fixed value of the method.
_BOUND = 2.0


def autocovariances(points: DataFrame, lags: DataFrame) -> DataFrame:
    """(series_id, n, lag, cov) for lags from 0 to ``most`` of (series_id, n, mean, most), by sums of lagged products over n.

    ``points`` is (series_id, at, x) without gaps in ``at``. A series is cut into chunks that carry the points before them.
    """
    dealt = points.join(lags, "series_id").withColumn("x", F.col("x") - F.col("mean"))
    own, last = F.floor(F.col("at") / CHUNK), F.floor((F.col("n") - 1) / CHUNK)
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(own, F.least(F.floor((F.col("at") + F.col("most")) / CHUNK), last))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        x, most = pdf["x"].to_numpy(), int(pdf["most"].iloc[0])
        first = int((pdf["at"] >= int(pdf["chunk"].iloc[0]) * CHUNK).to_numpy().argmax())
        # Products at all lags at once, by the transforms of the chunk's own points and of all that it has.
        size = 1 << (2 * len(x) - 1).bit_length()
        own = np.where(np.arange(len(x)) >= first, x, 0.0)
        sums = np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(x, size)), size)[: most + 1]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "n": pdf["n"].iloc[0], "lag": np.arange(most + 1), "part": sums})

    parts = dealt.groupBy("series_id", "chunk").applyInPandas(run, "series_id string, n long, lag int, part double")
    return parts.groupBy("series_id", "n", "lag").agg((F.sum("part") / F.col("n")).alias("cov"))


def _length(cov: np.ndarray, n: int, circular: bool) -> float:
    """The length that minimises the mean squared error of the variance of a mean, from autocovariances by a flat-top lag window."""
    if cov[0] <= 0:
        return 1.0
    run, most = _run(n), len(cov) - 1
    small = np.abs(cov[1:] / cov[0]) < _BOUND * math.sqrt(math.log10(n) / n)
    quiet = [k for k in range(most - run + 1) if small[k : k + run].all()]
    if quiet:
        cut = quiet[0]
    else:
        large = np.flatnonzero(~small)
        cut = int(large[-1]) + 1 if len(large) else 1
    width = min(2 * max(cut, 1), most)
    k = np.arange(1, width + 1)
    weight = np.minimum(1.0, 2.0 * (1.0 - k / width))
    slope, spectrum = 2 * (weight * k * cov[1 : width + 1]).sum(), cov[0] + 2 * (weight * cov[1 : width + 1]).sum()
    scale = (4 / 3 if circular else 2.0) * spectrum**2
    if scale <= 0:
        return 1.0
    best = (2 * slope**2 / scale) ** (1 / 3) * n ** (1 / 3)
    return float(min(best, math.ceil(min(3 * math.sqrt(n), n / 3))))


def _run(n: int) -> int:
    """How many lags in a row must be small."""
    return max(5, math.ceil(math.sqrt(math.log10(n)))) if n > 1 else 5


def block_lengths(series: DataFrame, value: str = "nav") -> DataFrame:
    """(series_id, n, circular, stationary, block_length) by the automatic rule; the last is ``circular`` in whole points, 2 at least.

    Rows without a value are left out. A series under 10 points or without spread has lengths of 1.
    """
    rows = series.filter(F.col(value).isNotNull()).select("series_id", "seq", F.col(value).cast("double").alias("x"), F.lit(1).cast("long").alias("one"))
    # Places among the rows with a value are counted by ranges, so no task sorts a series.
    points = written(running_sums(rows, ["series_id"], "seq", {"at": "one"}).select("series_id", "at", "x"))
    n = F.col("n")
    wide = F.ceil(F.sqrt(n)) + F.greatest(F.lit(5), F.ceil(F.sqrt(F.log10(n.cast("double")))))
    sizes = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")).withColumn("most", F.least(wide, n - 1).cast("int"))
    covs = autocovariances(points.select("series_id", "at", "x"), sizes.filter("n >= 10"))
    lists = covs.groupBy("series_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "cov"))), lambda r: r["cov"]).alias("cov"))

    @F.pandas_udf("circular double, stationary double")
    def lengths(cov: pd.Series, n: pd.Series) -> pd.DataFrame:
        both = [(_length(np.asarray(c), int(k), True), _length(np.asarray(c), int(k), False)) for c, k in zip(cov, n, strict=True)]
        return pd.DataFrame(both, columns=["circular", "stationary"])

    found = lists.select("series_id", lengths("cov", "n").alias("l")).select("series_id", "l.*")
    out = sizes.select("series_id", "n").join(found, "series_id", "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("circular", "stationary")})
    return out.withColumn("block_length", F.greatest(F.floor("circular"), F.lit(2)).cast("int"))


_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * _PRIMES[2]
    return h ^ (h >> np.uint64(32))


def byte_hashes(data: bytes, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of bytes under each unsigned seed, as ``xxhash64`` chains the columns of a row."""
    p1, p2, p3, p4, p5 = _PRIMES
    words = lambda at, kind: np.frombuffer(data, kind, 1, at).astype(np.uint64)
    at, h = 0, seeds + p5
    if len(data) >= 32:
        lanes = [seeds + p1 + p2, seeds + p2, seeds, seeds - p1]
        for at in range(0, len(data) - 31, 32):
            lanes = [_turned(v + words(at + 8 * k, "<u8") * p2, 31) * p1 for k, v in enumerate(lanes)]
        at += 32
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for v in lanes:
            h = (h ^ (_turned(v * p2, 31) * p1)) * p1 + p4
    h = h + np.uint64(len(data))
    for at in range(at, len(data) - 7, 8):
        h = _turned(h ^ (_turned(words(at, "<u8") * p2, 31) * p1), 27) * p1 + p4
    at = len(data) - len(data) % 8
    if len(data) - at >= 4:
        h = _turned(h ^ (words(at, "<u4") * p1), 23) * p2 + p3
        at += 4
    for at in range(at, len(data)):
        h = _turned(h ^ (words(at, "u1") * p5), 11) * p1
    return _ended(h)


def long_hashes(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of each long (row) under each unsigned seed (column)."""
    p1, p2, _, p4, p5 = _PRIMES
    mixed = _turned(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
    return _ended(_turned((seeds + p5 + np.uint64(8))[None, :] ^ mixed[:, None], 27) * p1 + p4)


def _draws(blocks: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Poisson draws of mean 1, 6 at most, of each block (row) in each replicate (column)."""
    u = (long_hashes(blocks, seeds) & np.uint64((1 << 30) - 1)).astype(np.float64) / float(1 << 30)
    out, below, p = np.zeros(u.shape), 0.0, math.exp(-1)
    for k in range(1, 7):
        below += p
        p /= k
        out += u >= below
    return out


_TERMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def bootstrap_importance(long: DataFrame, target: DataFrame, replicates: int = 100, block: int | None = None, seed: int = 42) -> DataFrame:
    """(feature, mean_importance, std_importance, cv) over block bootstraps of the rows.

    A replicate keeps a block as often as a Poisson draw hashed from (replicate, series, block) says. A batch of rows sums its
    blocks' products and adds them to all replicates at once, so neither rows nor blocks are multiplied or shuffled: a task returns
    its sums for each feature and replicate, and a block that lies in several batches is drawn alike in each. A series' blocks
    are as long as ``block_lengths`` of its target says, unless ``block`` does. Importance is the squared weighted correlation with the target.
    """
    rows = with_target(long, target).filter(F.col("value").isNotNull() & F.col("target").isNotNull())
    length = F.lit(block)
    if block is None:
        rows, length = rows.join(written(block_lengths(target, "target").select("series_id", "block_length")), "series_id"), F.col("block_length")
    rows = rows.select("feature", "series_id", F.floor(F.col("seq") / length).alias("block"), F.col("value").cast("double").alias("x"), F.col("target").cast("double").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = byte_hashes(int(seed).to_bytes(4, "little", signed=True), np.array([42], np.uint64))
        of_replicate = np.concatenate([byte_hashes(r.to_bytes(4, "little"), own) for r in range(replicates)]) if replicates else own[:0]
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            feature_at, features = pd.factorize(pdf["feature"], use_na_sentinel=False)
            series_at, series = pd.factorize(pdf["series_id"], use_na_sentinel=False)
            x, y, block = (pdf[c].to_numpy() for c in ("x", "y", "block"))
            terms = (np.ones(len(x)), x, y, x * x, y * y, x * y)
            for s, name in enumerate(series):
                of = series_at == s
                block_at, blocks = pd.factorize(block[of])
                place = feature_at[of] * len(blocks) + block_at
                sums = np.stack([np.bincount(place, t[of], len(features) * len(blocks)) for t in terms], 1).reshape(len(features), len(blocks), len(terms))
                drawn = _draws(blocks, byte_hashes(name.encode(), of_replicate) if name is not None else of_replicate).T
                for f, part in zip(features, sums, strict=True):
                    total[f] = total.get(f, 0.0) + drawn @ part
        for f, sums in total.items():
            yield pd.DataFrame({"feature": f, "replicate": np.arange(replicates), **dict(zip(_TERMS, sums.T, strict=True))})

    made = rows.mapInPandas(run, "feature string, replicate int, " + ", ".join(f"{t} double" for t in _TERMS))
    sums = made.groupBy("feature", "replicate").agg(*(F.sum(t).alias(t) for t in _TERMS)).filter("n > 0")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    scored = sums.withColumn("importance", F.coalesce(F.try_divide(cov * cov, var), F.lit(0.0)))
    by = scored.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"))
    return by.withColumn("cv", F.try_divide("std_importance", "mean_importance"))
