"""The audit of a range-bar threshold: bars, value index, rolling features and statistics of each feature."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars, measures, rolling, windows


def audited_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """Range bars of ticks (series_id, seq, price, quantity), each with ``nav``, its close over the series' first."""
    made = bars.range_bars(ticks, threshold)
    scaled = windows.normalize_prices(made.select(F.col("bar").alias("seq"), *(c for c in made.columns if c != "bar"), F.col("close").alias("nav")))
    return scaled.withColumn("nav", F.col("relative")).drop("relative")


def audit_threshold(audited: DataFrame, lookback: int) -> DataFrame:
    """(series_id, feature, n_bars, n_windows, n_positive, statistics) of each feature past its warm-up.

    ``n_positive`` counts windows above 0. Series with ``lookback`` bars or fewer are left out.
    """
    tall = rolling.long_features(rolling.rolling_features(audited.select("series_id", "seq", "nav"), (lookback,)), 0)
    warm = tall.filter(F.col("bar_index") >= lookback - 1)
    keys = ["series_id", "feature"]
    counted = warm.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("value") > 0).alias("n_positive"))
    return counted.withColumn("n_bars", F.col("n_windows") + lookback - 1).join(measures.audit_statistics(warm, keys, "value"), keys)


def write_audit(audited: DataFrame, features: DataFrame, stats: DataFrame, path: str) -> None:
    """Bars beside their features as CSV under ``features``, statistics as JSON lines under ``stats``."""
    wide = audited.join(features, ["series_id", "seq"], "left")
    wide.write.mode("overwrite").option("header", True).csv(f"{path}/features")
    stats.write.mode("overwrite").json(f"{path}/stats")
