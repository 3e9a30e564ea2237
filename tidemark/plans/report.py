"""The fitness report: one row for each series, qualified or not, with ranks. A plan over epochs and windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import epochs
from ..operators.measures import sharpe
from ..operators.windows import with_returns


def fitness_report(nav: DataFrame, hurdle: float, long: bool = True, periods: float = 252, day: str | None = None) -> DataFrame:
    """Epochs, points to an epoch, durations, spacing of epochs and of losses, and their larger one, by series.

    Durations run along the timeline of the first point, each epoch and the last point. Losses at epochs
    count where they are not 0, and the last loss counts if the last point is no epoch. The aggregate
    spread is NULL if either part is.
    """
    points = epochs.epoch_points(nav, hurdle, long)
    edges = epochs.epoch_timeline(points)
    if day:
        order = Window.partitionBy("series_id").orderBy("seq")
        dated = edges.join(nav.select("series_id", "seq", F.col(day).alias("_day")), ["series_id", "seq"])
        edges = dated.withColumn("days", F.datediff("_day", F.lag("_day").over(order)))
    else:
        edges = edges.withColumn("days", F.col("duration"))
    last = Window.partitionBy("series_id").orderBy(F.desc("seq"))
    counted = points.withColumn("is_last", F.row_number().over(last) == 1).filter(F.col("epoch") & (F.col("excess_loss") != 0) | F.col("is_last") & ~F.col("epoch"))
    losses = counted.groupBy("series_id").agg(F.try_divide(F.stddev_pop("excess_loss"), F.avg("excess_loss")).alias("loss_cv"))
    spacing = edges.groupBy("series_id").agg(F.try_divide(F.stddev_pop("duration"), F.avg("duration")).alias("epoch_cv"), F.max(F.when(F.col("from_end") <= 3, F.col("days"))).alias("recent_3_max"))
    by = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.sum(F.col("epoch").cast("int")).alias("n_epochs"))
    ratio = with_returns(nav).groupBy("series_id").agg(sharpe(F.col("ret"), periods).alias("sharpe_ratio"))
    both = F.col("loss_cv").isNotNull() & F.col("epoch_cv").isNotNull()
    out = by.join(spacing, "series_id").join(losses, "series_id", "left").join(ratio, "series_id")
    return out.withColumns({"points_to_epoch": F.try_divide(F.col("n_points") - 1, "n_epochs"), "aggregate_cv": F.when(both, F.greatest("loss_cv", "epoch_cv"))})


def qualified(report: DataFrame, sharpe_band: tuple[float, float], epoch_band: tuple[float, float], cv_band: tuple[float, float] = (0.0, 0.70), short: bool = False, bypass: bool = False) -> DataFrame:
    """Adds ``qualifies``: strictly inside all bands. A short report also takes any negative ratio."""

    def inside(c: str, band: tuple[float, float]) -> Column:
        return (F.col(c) > band[0]) & (F.col(c) < band[1])

    ratio = inside("sharpe_ratio", sharpe_band)
    if short:
        ratio = ratio | (F.col("sharpe_ratio") < 0)
    ok = F.lit(True) if bypass else ratio & inside("n_epochs", epoch_band) & inside("aggregate_cv", cv_band)
    return report.withColumn("qualifies", F.coalesce(ok, F.lit(False)))


def ranked(report: DataFrame, short: bool = False) -> DataFrame:
    """Adds the ranks that a result table is sorted by. A report has a row a series, so its ranks are over one small window each."""
    by = lambda c: F.rank().over(Window.orderBy(c))
    ratio = F.col("sharpe_ratio").asc_nulls_last() if short else F.col("sharpe_ratio").desc_nulls_last()
    return report.withColumns({"rank_cv": by(F.col("aggregate_cv").asc_nulls_last()), "rank_sharpe": by(ratio), "rank_recent": by(F.col("recent_3_max").asc_nulls_last())})
