"""Dependence of a target on features and their pasts: mutual information, lagged links, tree importance.

Counts and products are summed in Spark. What reaches the driver is one number for each pair of lagged
columns, whose number a configuration bounds.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import row_numbers
from .statistics import with_target


def binned_information(long: DataFrame, target: DataFrame, bins: int = 16) -> DataFrame:
    """(feature, information): mutual information, in nats, of rank bins of each feature and of the target.

    Bins are dealt by places among all rows of a feature, numbered by ranges. An estimate by equally filled bins; it stands for a nearest-neighbour estimate and grows with it.
    """
    rows = with_target(long, target).filter("value is not null and target is not null")
    rows = rows.select("feature", "series_id", "seq", "value", "target")
    sizes = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    for name, c in (("bx", "value"), ("by", "target")):
        ordered = rows.withColumns({"_v": F.col(c), "_s": F.col("series_id"), "_q": F.col("seq")})
        rows = row_numbers(ordered, ["feature"], ["_v", "_s", "_q"], f"_{name}")
    # Of n rows, the first n % bins bins have one more than the others, as ntile deals them.
    low, more = F.floor(F.col("n") / bins), F.col("n") % bins
    bin_ = lambda at: F.when(at < more * (low + 1), F.floor(at / (low + 1))).otherwise(more + F.floor((at - more * (low + 1)) / F.greatest(low, F.lit(1)))) + 1
    cells = rows.join(F.broadcast(sizes), "feature").withColumns({"bx": bin_(F.col("_bx")), "by": bin_(F.col("_by"))}).groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("k"))
    over = lambda *c: F.sum("k").over(Window.partitionBy("feature", *c))
    parts = cells.withColumns({"n": over(), "nx": over("bx"), "ny": over("by")})
    return parts.groupBy("feature").agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("information"))


def _lagged(long: DataFrame, target: DataFrame, tau: int) -> DataFrame:
    """(series_id, seq, name, x): the target, and each feature and the target at lags 1 to ``tau``, as a long table."""
    named = long.select("series_id", "seq", "feature", "value").unionByName(target.select("series_id", "seq", F.lit("target").alias("feature"), F.col("target").alias("value")))
    order = Window.partitionBy("series_id", "feature").orderBy("seq")
    held = named.withColumns({f"lag_{k}": F.lag("value", k).over(order) for k in range(1, tau + 1)})
    lags = [F.struct(F.concat(F.col("feature"), F.lit(f"@{k}")).alias("name"), F.col(f"lag_{k}").alias("x")) for k in range(1, tau + 1)]
    own = F.struct(F.col("feature").alias("name"), F.col("value").alias("x"))
    spread = held.select("series_id", "seq", F.explode(F.array(own, *lags)).alias("e")).select("series_id", "seq", "e.name", "e.x")
    return spread.filter(F.col("x").isNotNull() & (F.col("name").contains("@") | (F.col("name") == "target")))


def lagged_links(long: DataFrame, target: DataFrame, tau: int = 5, alpha: float = 0.05, most: int = 3) -> list[tuple[str, int, float, float]]:
    """(feature, lag, partial correlation, p) of the lagged columns tied to the target given its strongest other parents.

    Momentary conditional independence with partial correlations (Runge et al., 2019), from the correlation
    matrix of all lagged columns, which Spark sums in one pass over pairs at a position.
    """
    from .statistics import correlation_matrix, pair_correlations

    wide = _lagged(long, target, tau).select("series_id", "seq", F.col("name").alias("feature"), F.col("x").alias("value"))
    pairs = pair_correlations(wide, least=3)
    n = target.count() - tau
    names, m = correlation_matrix(pairs)
    at = {f: i for i, f in enumerate(names)}

    def partial(a: str, b: str, given: list[str]) -> tuple[float, float]:
        own = [at[a], at[b], *(at[g] for g in given)]
        p = np.linalg.pinv(m[np.ix_(own, own)])
        r = float(np.clip(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]), -0.999999, 0.999999))
        z = abs(0.5 * math.log((1 + r) / (1 - r))) * math.sqrt(max(n - len(given) - 3, 1))
        return r, math.erfc(z / math.sqrt(2))

    lagged = [f for f in names if "@" in f]
    parents = {f: abs(m[at[f], at["target"]]) for f in lagged if partial(f, "target", [])[1] < alpha}
    for size in range(1, most + 1):
        for f in sorted(parents, key=parents.get):
            given = [g for g in sorted(parents, key=parents.get, reverse=True) if g != f][:size]
            r, p = partial(f, "target", given)
            parents[f] = abs(r)
            if p >= alpha:
                del parents[f]
    out = []
    for f in lagged:
        given = [g for g in sorted(parents, key=parents.get, reverse=True) if g != f][: most + 1]
        r, p = partial(f, "target", given)
        if p < alpha and f in parents:
            name, lag = f.rsplit("@", 1)
            out.append((name, int(lag), r, p))
    return sorted(out, key=lambda x: (x[3], x[0], x[1]))


def beside_target(long: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    """(series_id, seq, *names, target): the points of a long table, features side by side."""
    return long.groupBy("series_id", "seq").pivot("feature", names).agg(F.first("value")).join(target, ["series_id", "seq"])


def grown_forest(points: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42):
    """A forest of regression trees of (*names, target), grown in Spark; points without a null."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=names, outputCol="x").transform(points).select("x", "target")
    return RandomForestRegressor(featuresCol="x", labelCol="target", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def tree_importance(long: DataFrame, target: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """``point_tree_importance`` of a long table and its target."""
    return point_tree_importance(beside_target(long, target, names), names, trees, depth, seed)


def point_tree_importance(points: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance) of points (*names, target) by a forest of regression trees; stands for mean absolute Shapley values. No point is shuffled."""
    model = grown_forest(points.na.drop(), names, trees, depth, seed)
    return points.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
