"""Ranks, running sums and order statistics of a key that no single task could hold.

A key's values are cut into ranges, each range is worked on by itself, and the totals of the ranges before it are added.
Ranges follow from exact aggregates of the values alone (least, greatest, counts), so a task that runs again cuts
them alike, and equal values always share a range, where they are one row with a count.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Ranges of equal width that a key is cut into, and distinct values of one from which it is cut again.
RANGES, ROWS = 1024, 200_000
#: Positions of one range of running sums.
SPAN = 1 << 17


def _range(value: str, low: str, high: str, parts: Column) -> Column:
    """Which of ``parts`` ranges of equal width between low and high; all in the first where there is no finite width."""
    at = F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low)) * parts
    return F.coalesce(F.when(~F.isnan(at), F.least(F.greatest(F.floor(at), F.lit(0)), parts - 1)), F.lit(0)).cast("int")


def counts_below(df: DataFrame, keys: list[str], value: str, rows: int | None = None, weight: str | None = None, **carried: Column) -> DataFrame:
    """(keys, value, c, below, n, *carried) for each distinct value of a key that isn't null: how often it occurs, how many are smaller, and how many there are.

    With ``weight``, rows count as often as that column says; those of weight 0 ask without being counted. ``carried`` are
    further aggregates over the rows of a value. Distinct values and the tables of ranges are written, so that their joins know
    their sizes: few ranges are broadcast, and values aren't shuffled by key, where few keys would be few tasks.
    """
    distinct = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"), *(c.alias(k) for k, c in carried.items())))
    ends = written(distinct.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("c").alias("n")))
    coarse = distinct.join(ends, keys).withColumn("_a", _range(value, "_low", "_high", F.lit(RANGES)))
    within = written(coarse.groupBy(*keys, "_a").agg(F.min(value).alias("_from"), F.max(value).alias("_to"), F.ceil(F.count(F.lit(1)) / F.lit(rows or ROWS)).cast("int").alias("_parts")))
    fine = coarse.join(within, [*keys, "_a"]).withColumn("_b", _range(value, "_from", "_to", F.col("_parts"))).select(*keys, value, "c", "n", *carried, "_a", "_b")
    totals = fine.groupBy(*keys, "_a", "_b").agg(F.sum("c").alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(totals.select(*keys, "_a", "_b", F.coalesce(earlier, F.lit(0)).alias("_before")))
    local = F.sum("c").over(Window.partitionBy(*keys, "_a", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    placed = fine.withColumn("_local", F.coalesce(local, F.lit(0))).join(offsets, [*keys, "_a", "_b"])
    return placed.select(*keys, value, "c", (F.col("_before") + F.col("_local")).alias("below"), "n", *carried)


def average_ranks(df: DataFrame, keys: list[str], value: str = "value", name: str = "rank") -> DataFrame:
    """Adds the average rank of each value among its key's, from 1; NULL for a null value, which isn't counted."""
    ranks = counts_below(df, keys, value).select(*keys, value, (F.col("below") + (F.col("c") + 1) / 2).cast("double").alias(name))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, name)


def at_position(df: DataFrame, keys: list[str], value: str, **places: Column) -> DataFrame:
    """(keys, n, *places): the values at so many places of the sorted values of each key; places are of ``n``, from 0."""
    found = counts_below(df, keys, value)
    held = {k: F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("c")), F.col(value))) for k, at in places.items()}
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(c.alias(k) for k, c in held.items()))


def running_sums(df: DataFrame, keys: list[str], at: str, columns: dict[str, str], span: int | None = None) -> DataFrame:
    """Adds the sums of columns over all rows of a key with a smaller integer position; ``columns`` names them: new for old."""
    cut = df.withColumn("_range", F.floor(F.col(at) / F.lit(span or SPAN)))
    totals = cut.groupBy(*keys, "_range").agg(*(F.sum(old).alias(f"_{new}") for new, old in columns.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in columns))
    local = Window.partitionBy(*keys, "_range").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumns({new: F.coalesce(F.sum(old).over(local), F.lit(0)) for new, old in columns.items()}).join(offsets, [*keys, "_range"])
    return summed.select(*df.columns, *((F.col(new) + F.col(f"_{new}")).alias(new) for new in columns))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Adds the place of each row among its key's, from 0; the columns of ``order`` are left out.

    Rows are sorted by ranges of keys and order, so no task holds a key, and are written; a row's place in its range follows from its
    place in the file's partition, and the counts of the ranges before are added. These are as many as keys and ranges, and are broadcast.
    """
    kept = [c for c in df.columns if c not in order]
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*kept, F.monotonically_increasing_id().alias("_id"))
    rows = written(cut).withColumn("_range", F.shiftright("_id", 33))
    counts = rows.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_own"), (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.col("_range") == F.col("_own")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(F.broadcast(starts), on).select(*kept, (F.col("_id") + F.col("_shift")).alias(name))
