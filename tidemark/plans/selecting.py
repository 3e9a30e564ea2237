"""Feature selection as a chain: variance, then mutual correlation, then information about the target.

Every step's statistics are Spark aggregates over all rows; the driver sees one number a feature, or a pair
of features, of a configuration.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.causal import binned_information
from ..operators.selection import by_correlation, by_variance
from ..operators.statistics import pair_correlations, variance_inflation


def select_subset(long: DataFrame, target: DataFrame, k: int = 24, least_variance: float = 0.01, limit: float = 0.95) -> DataFrame:
    """(feature, variance_kept, correlation_kept, place): what became of each feature at each step.

    ``place`` counts the chosen ones from 1 by information about the target, most first, ties by name; it is
    NULL for a feature that went at an earlier step or is beyond the ``k`` best.
    """
    spark = long.sparkSession
    names = sorted(r.feature for r in long.select("feature").distinct().collect())
    varied = {r.feature for r in by_variance(long, least_variance).collect()}
    rest = long.filter(F.col("feature").isin(sorted(varied)))
    kept = by_correlation(rest, limit, sorted(varied)) if len(varied) > 1 else sorted(varied)
    told = binned_information(rest.filter(F.col("feature").isin(kept)), target).collect() if kept else []
    best = [r.feature for r in sorted(told, key=lambda r: (-round(r.information, 9), r.feature))[:k]]
    rows = [(f, f in varied, f in kept, best.index(f) + 1 if f in best else None) for f in names]
    return spark.createDataFrame(rows, "feature string, variance_kept boolean, correlation_kept boolean, place int")


def redundant_features(long: DataFrame, limit: float = 0.95, most_inflation: float = 10.0) -> DataFrame:
    """(feature, by_correlation, by_inflation, redundant): tied to one kept before it, or explained by the others."""
    names = sorted(r.feature for r in long.select("feature").distinct().collect())
    kept = set(by_correlation(long, limit, names))
    inflation = variance_inflation(pair_correlations(long)) if len(names) > 1 else {}
    rows = [(f, f not in kept, inflation.get(f, 1.0) > most_inflation) for f in names]
    return long.sparkSession.createDataFrame([(*r, r[1] or r[2]) for r in rows], "feature string, by_correlation boolean, by_inflation boolean, redundant boolean")
