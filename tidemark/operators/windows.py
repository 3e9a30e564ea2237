"""Order-dependent operators that native windows can say."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..series import point_window, so_far
from .spread import counts_below, running_sums

_ALL = Window.unboundedPreceding, Window.unboundedFollowing


#: Points of a chunk of a long series.
CHUNK = 1 << 16


def per_series(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with what ``table`` says of their series, of the one without a name as well."""
    own = table.withColumnRenamed("series_id", "_own")
    return df.join(own, df["series_id"].eqNullSafe(own["_own"])).drop("_own")


def with_lags(nav: DataFrame, k: int) -> DataFrame:
    """Adds ``before1`` to ``before{k}``, the values so many points before, unless they are there; ``seq`` counts without gaps.

    Series are cut into chunks that carry the points before them, so no task sorts one.
    """
    if f"before{k}" in nav.columns:
        return nav
    own, last = F.floor(F.col("seq") / CHUNK), F.floor((F.col("seq") + k) / CHUNK)
    dealt = nav.withColumn("_chunk", F.explode(F.sequence(own, last)))
    order = Window.partitionBy("series_id", "_chunk").orderBy("seq")
    made = dealt.withColumns({f"before{i}": F.lag("nav", i).over(order) for i in range(1, k + 1)})
    return made.filter(F.col("_chunk") == own).drop("_chunk")


def with_peak(nav: DataFrame) -> DataFrame:
    """Adds ``peak``, the greatest value up to each point: of its chunk so far and of the chunks before."""
    cut = nav.withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    tops = cut.groupBy("series_id", "_chunk").agg(F.max("nav").alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy("series_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = tops.select(F.col("series_id").alias("_own"), F.col("_chunk").alias("_at"), earlier.alias("_before"))
    local = F.max("nav").over(Window.partitionBy("series_id", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    met = cut.withColumn("_local", local).join(before, F.col("series_id").eqNullSafe(F.col("_own")) & (F.col("_chunk") == F.col("_at")))
    return met.select(*nav.columns, F.greatest("_before", "_local").alias("peak"))


def with_returns(nav: DataFrame, kind: str = "fraction") -> DataFrame:
    """Adds ``ret``: the change as a ``fraction`` of the point before (0 at the first) or as a ``diff``.

    A base within machine epsilon of 0 gives 0. The first point has NULL for ``open`` kinds
    (``open_fraction``, ``open_diff``), which leave out the artificial zero.
    """
    before = F.col("before1") if "before1" in nav.columns else F.lag("nav").over(point_window())
    diff = F.col("nav") - before
    value = diff if kind.endswith("diff") else F.when(F.abs(before) > X.EPS, F.try_divide(diff, before)).when(before.isNotNull(), F.lit(0.0))
    return nav.withColumn("ret", value if kind.startswith("open") else F.coalesce(value, F.lit(0.0)))


def build_nav(prices: DataFrame, floor: float = -0.99) -> DataFrame:
    """A value index ``built`` from 1.0 by compounding returns, none below ``floor``, and its logarithm ``log_built``, which long series can't take beyond doubles.

    Logarithms are added up as multiples of 2^-20, whose sums are exact, and small rests, so the error doesn't grow with the series.
    """
    bounded = with_returns(prices).withColumn("growth", F.lit(1.0) + F.greatest("ret", F.lit(floor)))
    step = F.log("growth")
    whole = F.rint(step * F.lit(2.0**20)) * F.lit(2.0**-20)
    rest = F.when(F.abs(step) < F.lit(float("inf")), step - whole).otherwise(F.lit(0.0))
    return bounded.withColumn("log_built", F.sum(whole).over(so_far()) + F.sum(rest).over(so_far())).withColumn("built", F.exp("log_built"))


def normalize_prices(prices: DataFrame) -> DataFrame:
    """Each price over the series' first; infinite, or NaN for a zero, where that is zero."""
    first = F.first("nav").over(point_window().rowsBetween(*_ALL))
    return prices.withColumn("relative", X.divided(F.col("nav"), first))


def episodes(nav: DataFrame) -> DataFrame:
    """Adds peak, new_high, episode (between new highs) and trough (lowest value of the episode so far)."""
    staged = nav.withColumn("peak", F.max("nav").over(so_far()))
    staged = staged.withColumn("new_high", F.coalesce((F.col("peak") > F.lag("peak").over(point_window())).cast("int"), F.lit(0)))
    staged = staged.withColumn("episode", F.sum("new_high").over(so_far()))
    return staged.withColumn("trough", F.min("nav").over(so_far("episode")))


def drawdown_spikes(nav: DataFrame) -> DataFrame:
    """Adds ``spike``: each episode's deepest fall, absolute, at the first row that reaches it, and 0 elsewhere."""
    fallen = episodes(nav).withColumn("fall", F.when((F.col("seq") > 0) & (F.col("new_high") == 0), F.col("peak") - F.col("trough")).otherwise(F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("series_id", "episode").orderBy(F.desc("fall"), "seq"))
    return fallen.withColumn("spike", F.when((rank == 1) & (F.col("fall") > 0), F.col("fall")).otherwise(F.lit(0.0)))


def rank_normalize(df: DataFrame, value: str, partition: str = "series_id") -> DataFrame:
    """Adds ``ranked``: average ranks from 0 to 1; a lone value gets 0.5, a null NULL."""
    ranks = counts_below(df, [partition], value)
    share = F.when(F.col("n") <= 1, F.lit(0.5)).otherwise(F.try_divide(F.col("below") + (F.col("c") - 1) / 2, F.col("n") - 1))
    return df.join(ranks.select(partition, value, share.alias("ranked")), [partition, value], "left").select(*df.columns, "ranked")


def rank_against(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(series_id, seq, share): the part of the reference values of a series strictly below each value; 0.5 without a value or a reference.

    Both sets are ranked together by ranges of values, which takes no join of pairs and no sort of a whole series.
    """
    asked = values.select("series_id", "nav", F.lit(0).alias("w")).unionByName(reference.select("series_id", "nav", F.lit(1).alias("w")))
    below = counts_below(asked, ["series_id"], "nav", weight="w").select("series_id", "nav", F.try_divide("below", "n").alias("share"))
    return values.select("series_id", "seq", "nav").join(below, ["series_id", "nav"], "left").select("series_id", "seq", F.coalesce("share", F.lit(0.5)).alias("share"))


def positions(df: DataFrame) -> DataFrame:
    """Adds position, is_first and is_last of each row in its series."""
    back = Window.partitionBy("series_id").orderBy(F.desc("seq"))
    return df.withColumns({
        "position": F.row_number().over(point_window()) - 1,
        "is_first": (F.row_number().over(point_window()) == 1).cast("int"),
        "is_last": (F.row_number().over(back) == 1).cast("int"),
    })


def continuity(df: DataFrame, position: str = "position", first: str = "is_first", last: str = "is_last") -> DataFrame:
    """(series_id, n_rows, n_first, n_last, n_gaps, continuous): whether positions run 0 to n - 1 with one first and one last."""
    order = Window.partitionBy("series_id").orderBy(position)
    gaps = df.withColumn("off", (F.col(position) != F.row_number().over(order) - 1).cast("int"))
    by = gaps.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(first).alias("n_first"), F.sum(last).alias("n_last"), F.sum("off").alias("n_gaps"))
    return by.withColumn("continuous", (F.col("n_first") == 1) & (F.col("n_last") == 1) & (F.col("n_gaps") == 0))


def walk_forward_windows(lengths: DataFrame, train: int, test: int, anchors: int = 4, spacing: int | None = None, step: int | None = None, expanding: bool = True) -> DataFrame:
    """(series_id, anchor, window, train_start, train_end, test_start, test_end) of all walk-forward windows.

    ``lengths`` has series_id and n. Anchors lie ``spacing`` apart (by default a quarter of the length over
    the number of anchors) and windows advance by ``step`` (by default the test's size); ends are exclusive.
    """
    gap = F.lit(spacing) if spacing else F.greatest(F.lit(1), F.floor(F.floor(F.col("n") / 4) / F.lit(anchors)).cast("int"))
    by_anchor = lengths.select("series_id", F.col("n").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(anchors - 1))).alias("anchor"), gap.cast("int").alias("gap"))
    fits = F.floor((F.col("n") - F.col("anchor") * F.col("gap") - F.lit(train + test)) / F.lit(step or test)).cast("int")
    placed = by_anchor.withColumn("fits", fits).filter("fits >= 0").withColumn("window", F.explode(F.sequence(F.lit(0), F.col("fits"))))
    begin = F.col("anchor") * F.col("gap")
    moved = begin + F.col("window") * F.lit(step or test)
    return placed.select(
        "series_id", "anchor", "window", (begin if expanding else moved).alias("train_start"), (moved + train).alias("train_end"), (moved + train).alias("test_start"), (moved + train + test).alias("test_end")
    )


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each window's training and test part.

    A series is cut into cells as long as its shortest test part; windows are dealt to the cells that they cover and rows to
    their own, so a row meets only windows around it: the join makes what it returns and little else. For sums and
    counts, ``window_totals`` makes no row for each window at all.
    """
    sizes = windows.groupBy("series_id").agg(F.greatest(F.min(F.col("test_end") - F.col("test_start")), F.lit(1)).alias("_size"))
    cell = lambda at: F.floor(at / F.col("_size"))
    covered = windows.join(sizes, "series_id").withColumn("_cell", F.explode(F.sequence(cell(F.col("train_start")), cell(F.col("test_end") - 1)))).drop("_size")
    dealt = rows.join(sizes, "series_id").withColumn("_cell", cell(F.col("seq"))).drop("_size")
    joined = dealt.join(covered, ["series_id", "_cell"]).filter((F.col("seq") >= F.col("train_start")) & (F.col("seq") < F.col("test_end"))).drop("_cell")
    return joined.withColumn("part", F.when(F.col("seq") < F.col("train_end"), "train").otherwise("test"))


def window_totals(rows: DataFrame, windows: DataFrame, value: str = "nav") -> DataFrame:
    """(series_id, anchor, window, part, n, n_valid, total): rows, values and their sum in each part of each window that has rows.

    Parts are differences of running sums at their ends, so the work is one pass over the points and four rows for
    each window, however long its training part has grown. The total of no values is NULL.
    """
    ends = (("train", -1, "train_start"), ("train", 1, "train_end"), ("test", -1, "test_start"), ("test", 1, "test_end"))
    asked = windows.select("series_id", "anchor", "window", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("sign"), F.col(c).cast("long").alias("at")) for p, s, c in ends))).alias("e")).select("series_id", "anchor", "window", "e.*")
    v = F.col(value).cast("double")
    points = rows.select("series_id", F.col("seq").alias("at"), F.lit(1).alias("one"), v.isNotNull().cast("int").alias("valid"), F.coalesce(v, F.lit(0.0)).alias("x"))
    marks = asked.select("series_id", "at", F.lit(0).alias("one"), F.lit(0).alias("valid"), F.lit(0.0).alias("x")).distinct()
    merged = points.unionByName(marks).groupBy("series_id", "at").agg(F.sum("one").alias("one"), F.sum("valid").alias("valid"), F.sum("x").alias("x"))
    sums = running_sums(merged, ["series_id"], "at", {"n": "one", "n_valid": "valid", "total": "x"})
    met = asked.join(sums.select("series_id", "at", "n", "n_valid", "total"), ["series_id", "at"])
    by = met.groupBy("series_id", "anchor", "window", "part").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "n_valid", "total")))
    return by.filter("n > 0").withColumn("total", F.when(F.col("n_valid") > 0, F.col("total")))


def window_extremes(rows: DataFrame, windows: DataFrame, value: str = "nav") -> DataFrame:
    """(series_id, anchor, window, part, low, high): the least and greatest value in each part of each window that has rows.

    Rows are summed up in blocks of 1, 8, 64, ... positions, and a part takes the fewest whole blocks that make it up, fourteen
    of a size at most: so the work is a row's few blocks and a window's few, however long its training part has grown.
    """
    top = windows.agg(F.max("test_end")).first()[0] or 0
    levels, size = 1, 8
    while size <= top:
        levels, size = levels + 1, size * 8
    last = levels - 1
    block = lambda k: F.struct(F.lit(k).alias("level"), F.floor(F.col("seq") / 8**k).alias("block"))
    spread = rows.repartition(F.col("series_id"), F.floor(F.col("seq") / 8**5))
    points = spread.select("series_id", F.col(value).alias("_v"), F.explode(F.array(*map(block, range(levels)))).alias("b"))
    blocks = points.groupBy("series_id", "b.level", "b.block").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").cast("long").alias("a"), F.col(f"{p}_end").cast("long").alias("z")) for p in ("train", "test")))
    asked = windows.select("series_id", "anchor", "window", F.explode(parts).alias("p")).select("series_id", "anchor", "window", "p.*")
    first, end = [F.ceil(F.col("a") / 8**k) for k in range(levels + 1)], [F.floor(F.col("z") / 8**k) for k in range(levels + 1)]
    span = lambda a, z: F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))

    def of_level(k: int) -> Column:
        own = span(first[k], end[k])
        if k < last:
            larger = F.concat(span(first[k], first[k + 1] * 8), span(end[k + 1] * 8, end[k]))
            own = F.when(first[k + 1] < end[k + 1], larger).otherwise(own)
        return F.transform(own, lambda b: F.struct(F.lit(k).alias("level"), b.alias("block")))

    covered = asked.withColumn("b", F.explode(F.concat(*map(of_level, range(levels))))).select("series_id", "anchor", "window", "part", "b.*")
    # Few lengths become many windows, which Spark doesn't expect: it would broadcast them.
    met = covered.hint("merge").join(blocks, ["series_id", "level", "block"])
    return met.groupBy("series_id", "anchor", "window", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def evaluate_extremes(rows: DataFrame, windows: DataFrame, score: Callable[[Column, Column], Column], value: str = "nav") -> DataFrame:
    """(series_id, anchor, window, score) of a user's function of the extremes (low, high) of each window's training and test part.

    What ``evaluate`` gives for a function of extremes, without a group of all rows of each window.
    """
    found = window_extremes(rows, windows, value)
    of = lambda p: F.max(F.when(F.col("part") == p, F.struct("low", "high"))).alias(p)
    by = found.groupBy("series_id", "anchor", "window").agg(of("train"), of("test"))
    made = score(F.col("train"), F.col("test")).cast("double")
    return by.select("series_id", "anchor", "window", F.when(~F.isnan(made), made).alias("score"))


def evaluate(rows: DataFrame, windows: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], float]) -> DataFrame:
    """(series_id, anchor, window, score) of a user's function of each window's training and test rows.

    A window is one group; rolling windows have a fixed size, anchored ones grow with their series, so that rows grow with
    its square: ``evaluate_extremes`` and ``window_totals`` take functions of extremes and sums without that.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        value = score(pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"])
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "anchor": [pdf["anchor"].iloc[0]], "window": [pdf["window"].iloc[0]], "score": [None if value is None or value != value else float(value)]})

    return in_windows(rows, windows).groupBy("series_id", "anchor", "window").applyInPandas(run, "series_id string, anchor int, window int, score double")


def awfo_scores(scores: DataFrame, how: str = "mean") -> DataFrame:
    """(anchor, mean, std) and the overall score of (anchor, window, score), missing scores left out."""
    valid = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    by = valid.groupBy("series_id", "anchor").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count(F.lit(1)).alias("n_windows"))
    pooled = F.avg("mean_score") if how == "mean" else F.expr("percentile(mean_score, 0.5)")
    return by.join(by.groupBy("series_id").agg(pooled.alias("overall")), "series_id")


def year_segments(ticks: DataFrame, ts: str = "ts") -> DataFrame:
    """The series cut at New Year: series_id becomes ``series:year`` and seq restarts."""
    named = ticks.withColumn("series_id", F.concat_ws(":", "series_id", F.year(ts).cast("string")))
    return named.withColumn("seq", F.row_number().over(point_window()).cast("long") - 1)


def year_ranges(start: Column, end: Column) -> Column:
    """Array of (year, first day, last day) that a range of dates covers."""
    first = lambda y: F.to_date(F.concat(y.cast("string"), F.lit("-01-01")))
    last = lambda y: F.to_date(F.concat(y.cast("string"), F.lit("-12-31")))
    return F.transform(F.sequence(F.year(start), F.year(end)), lambda y: F.struct(y.alias("year"), F.greatest(first(y), start).alias("start"), F.least(last(y), end).alias("end")))
