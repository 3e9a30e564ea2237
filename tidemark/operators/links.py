"""Lagged causal links by momentary conditional independence with partial correlations (Runge and others, 2019).

Spark makes one matrix: the lagged correlations of all features and the target, summed as products of blocks of rows. All
tests follow from it on the driver, p by p numbers for each lag of a configuration: each variable's lagged parents
are those that stay dependent given ever more of its other, stronger parents, until no more are left to condition on;
then every link is tested given the parents of both its ends. A partial correlation sweeps the conditions out of the
matrix of the variables that it takes part in.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import point_window

#: Rows that an analysis needs. Fixed value of the definition.
LEAST = 50
Lagged = tuple[int, int]


def lagged_correlations(long: DataFrame, target: DataFrame, most: int, names: list[str]) -> tuple[int, np.ndarray]:
    """(rows, matrices): entry [k, i, j] is the correlation of variable i with variable j k rows before; the target comes last.

    Rows that lack a feature or the target are left out, and those around them follow each other.
    """
    wide = long.filter(F.col("feature").isin(names)).groupBy("series_id", "seq").pivot("feature", names).agg(F.first("value"))
    rows = wide.join(target.select("series_id", "seq", F.col("target").alias("_target")), ["series_id", "seq"]).na.drop()
    every = [*(F.col(f"`{n}`").cast("double") for n in names), F.col("_target").cast("double")]
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in every)).alias("mean"), F.array(*(F.stddev_pop(c) for c in every)).alias("spread")).first()
    p, n = len(every), sizes["n"]
    if n < LEAST:
        return n, np.zeros((most + 1, p, p))
    scaled = F.array(*((c - F.lit(m)) / F.lit(s if s and s > 0 else 1.0) for c, m, s in zip(every, sizes["mean"], sizes["spread"], strict=True)))
    held = rows.select("series_id", "seq", scaled.alias("v0")).withColumns({f"v{k}": F.lag("v0", k).over(point_window()) for k in range(1, most + 1)})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((most + 1, p, p)), np.zeros(most + 1)
        for b in batches:
            now = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, p)
            for k in range(most + 1):
                known = b.column(k).is_valid().to_numpy(zero_copy_only=False)
                if known.any():
                    total[k] += now[known].T @ np.array(b.column(k).drop_null().to_pylist(), np.float64)
                    count[k] += known.sum()
        flat = np.concatenate([total.ravel(), count])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "x"])

    summed = held.select(*(f"v{k}" for k in range(most + 1))).mapInArrow(products, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    flat = np.zeros((most + 1) * p * p + most + 1)
    for r in summed.collect():
        flat[r["at"]] = r["x"]
    counts = np.maximum(flat[(most + 1) * p * p :], 1)
    return n, flat[: (most + 1) * p * p].reshape(most + 1, p, p) / counts[:, None, None]


def swept(m: np.ndarray, k: int) -> np.ndarray:
    """``m`` with variable k taken out of all others."""
    return m - np.outer(m[:, k], m[k]) / m[k, k] if m[k, k] > 1e-12 else m


class Tests:
    """Partial correlations of lagged variables (variable, lag) and their p by Fisher's z."""

    def __init__(self, n: int, matrices: np.ndarray):
        self.n, self.matrices = n, matrices

    def correlation(self, a: Lagged, b: Lagged) -> float:
        k = b[1] - a[1]
        return float(self.matrices[k, a[0], b[0]] if k >= 0 else self.matrices[-k, b[0], a[0]])

    def partial(self, a: Lagged, b: Lagged, given: list[Lagged]) -> tuple[float, float]:
        nodes = [a, b, *given]
        m = np.array([[self.correlation(x, y) for y in nodes] for x in nodes])
        for k in range(2, len(nodes)):
            m = swept(m, k)
        scale = math.sqrt(max(m[0, 0], 0.0) * max(m[1, 1], 0.0))
        r = min(max(m[0, 1] / scale, -0.9999999), 0.9999999) if scale > 1e-12 else 0.0
        return float(r), math.erfc(abs(math.atanh(r)) * math.sqrt(max(self.n - len(given) - 3, 1)) / math.sqrt(2))

    def parents(self, y: int, variables: int, tau: int, alpha: float) -> list[Lagged]:
        """The lagged variables that stay dependent with ``y`` given any number of its stronger others, strongest first."""
        strength = {(i, k): math.inf for i in range(variables) for k in range(1, tau + 1)}
        size = 0
        while size <= len(strength) - 1 or size == 0:
            order, gone = sorted(strength, key=lambda x: (-strength[x], x)), []
            for x in order:
                r, p = self.partial(x, (y, 0), [z for z in order if z != x][:size])
                strength[x] = min(strength[x], abs(r))
                if p > alpha:
                    gone.append(x)
            for x in gone:
                del strength[x]
            size += 1
            if not strength:
                break
        return sorted(strength, key=lambda x: (-strength[x], x))


def causal_tests(long: DataFrame, target: DataFrame, tau: int = 5, alpha: float = 0.2) -> list[tuple[str, int, float, float]]:
    """(feature, lag, strength, p) of every link from a feature at lags 0 to ``tau`` to the target; empty below ``LEAST`` rows."""
    names = sorted(r.feature for r in long.select("feature").distinct().collect())
    n, matrices = lagged_correlations(long, target, 2 * tau, names)
    if n < LEAST:
        return []
    tests, y = Tests(n, matrices), len(names)
    parents = [tests.parents(i, len(names) + 1, tau, alpha) for i in range(len(names) + 1)]
    out = []
    for i, name in enumerate(names):
        for k in range(tau + 1):
            given = [z for z in parents[y] if z != (i, k)]
            given += [(j, lag + k) for j, lag in parents[i] if (j, lag + k) not in given and (j, lag + k) != (i, k)]
            out.append((name, k, *tests.partial((i, k), (y, 0), given)))
    return out


def causal_features(long: DataFrame, target: DataFrame, tau: int = 5, alpha: float = 0.05) -> DataFrame:
    """(feature, linked): whether any link from the feature to the target has a p below ``alpha``."""
    found = causal_tests(long, target, tau, alpha)
    names = sorted({f for f, *_ in found})
    return long.sparkSession.createDataFrame([(f, any(p < alpha for g, _, _, p in found if g == f)) for f in names], "feature string, linked boolean")


def causal_strengths(long: DataFrame, target: DataFrame, tau: int = 5) -> DataFrame:
    """(feature, min_pvalue, best_lag, causal_strength): of each feature the link to the target with the least p; the smallest lag of equals."""
    found = causal_tests(long, target, tau)
    rows = []
    for f in sorted({f for f, *_ in found}):
        _, lag, r, p = min((x for x in found if x[0] == f), key=lambda x: (x[3], x[1]))
        rows.append((f, p, lag, abs(r)))
    return long.sparkSession.createDataFrame(rows, "feature string, min_pvalue double, best_lag int, causal_strength double")
