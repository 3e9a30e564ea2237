"""Choosing features: greedy filters over small matrices, rank aggregation, importance by resampling.

Sums over rows run in Spark; what reaches the driver is one number for each feature or pair of features.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .statistics import correlation_with_target, pair_correlations, with_target


def by_variance(long: DataFrame, least: float = 0.01) -> DataFrame:
    """(feature, variance) of the features whose sample variance is at least ``least``."""
    return long.groupBy("feature").agg(F.var_samp("value").alias("variance")).filter(F.col("variance") >= least)


def greedy_keep(order: list[str], pairs: list[tuple[str, str, float]], limit: float) -> list[str]:
    """Features of ``order`` that no feature kept before them is tied to beyond ``limit``."""
    tied: dict[str, set[str]] = {}
    for a, b, r in pairs:
        if r is not None and abs(r) > limit:
            tied.setdefault(a, set()).add(b)
            tied.setdefault(b, set()).add(a)
    kept: list[str] = []
    for f in order:
        if not tied.get(f, set()) & set(kept):
            kept.append(f)
    return kept


def by_correlation(long: DataFrame, limit: float = 0.95, order: list[str] | None = None) -> list[str]:
    names = order or [r.feature for r in long.select("feature").distinct().orderBy("feature").collect()]
    return greedy_keep(names, [tuple(r) for r in pair_correlations(long).select("feature_a", "feature_b", "r").collect()], limit)


def mrmr(long: DataFrame, target: DataFrame, k: int) -> list[tuple[str, float]]:
    """Maximum relevance, minimum redundancy (Ding and Peng, 2005): F statistic over mean correlation with those chosen."""
    n = target.count()
    r = {x.feature: x.r or 0.0 for x in correlation_with_target(long, target).collect()}
    relevance = {f: v * v / max(1 - v * v, 1e-12) * max(n - 2, 1) for f, v in r.items()}
    tie = {frozenset(x[:2]): abs(x[2] or 0.0) for x in pair_correlations(long).select("feature_a", "feature_b", "r").collect()}
    chosen: list[tuple[str, float]] = []
    while len(chosen) < min(k, len(r)):
        score = lambda f: relevance[f] / max(np.mean([tie.get(frozenset((f, c)), 0.0) for c, _ in chosen]), 1e-3) if chosen else relevance[f]
        best = max(sorted(set(r) - {c for c, _ in chosen}), key=score)
        chosen.append((best, float(score(best))))
    return chosen


def borda(rankings: DataFrame) -> DataFrame:
    """(feature, points) of (method, feature, score): each method gives n less the place, n being the number of features in all."""
    n = rankings.select("feature").distinct().agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "feature"))
    placed = rankings.withColumn("place", place - 1).crossJoin(F.broadcast(n))
    return placed.groupBy("feature").agg(F.sum(F.col("n") - F.col("place")).alias("points")).orderBy(F.desc("points"), "feature")


def walk_forward_stability(long: DataFrame, target: DataFrame, folds: int = 5) -> DataFrame:
    """(feature, mean_importance, std_importance, cv) over expanding folds of the positions."""
    rows = with_target(long, target)
    sizes = rows.groupBy("series_id", "feature").agg(F.count(F.lit(1)).alias("n"))
    own = F.greatest(F.floor(F.col("seq") * (folds + 1) / F.col("n")).cast("int"), F.lit(1))
    grown = rows.join(sizes, ["series_id", "feature"]).withColumn("first_fold", own).withColumn("fold", F.explode(F.sequence(F.col("first_fold"), F.greatest(F.lit(folds), F.col("first_fold"))))).filter(F.col("fold") <= folds)
    scored = grown.groupBy("feature", "fold").agg(F.pow(F.corr("value", "target"), F.lit(2)).alias("importance"))
    by = scored.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"))
    return by.withColumn("cv", F.try_divide("std_importance", "mean_importance"))
