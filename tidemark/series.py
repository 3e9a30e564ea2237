"""Canonical ordered series: long frames (series_id, seq, ..., nav), one row a point.

Position is explicit. ``ordered`` numbers the rows of each series from 0 by the given keys, so every
operator downstream partitions by ``series_id`` and orders by ``seq``; ties must be broken by the keys.
Missing values are NULL, never NaN.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(df: DataFrame, series: Column, keys: list[Column], **columns: Column) -> DataFrame:
    """(series_id, seq, *columns) with ``seq`` counting from 0 within a series."""
    rows = df.select(series.cast("string").alias("series_id"), *(c.alias(n) for n, c in columns.items()), *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    order = Window.partitionBy("series_id").orderBy(*(f"_k{i}" for i in range(len(keys))))
    return rows.withColumn("seq", F.row_number().over(order).cast("long") - 1).select("series_id", "seq", *columns)


def ordered_by_ranges(df: DataFrame, series: Column, keys: list[Column], **columns: Column) -> DataFrame:
    """``ordered`` for few series that no task could sort: rows are numbered by ranges and written to the shared folder."""
    from .operators.spread import row_numbers

    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(series.cast("string").alias("series_id"), *(c.alias(n) for n, c in columns.items()), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    return row_numbers(rows, ["series_id"], names).select("series_id", "seq", *columns)


def point_window(*extra: str) -> Window:
    """The window of a series in order; ``extra`` columns partition it further."""
    return Window.partitionBy("series_id", *extra).orderBy("seq")


def so_far(*extra: str) -> Window:
    """All points up to this one."""
    return point_window(*extra).rowsBetween(Window.unboundedPreceding, 0)


def nav_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long series: the event values of each type in time order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ordered(e, F.col("event_type"), [F.col("ts"), F.col("event_id")], ts=F.col("ts"), nav=F.col("value"))


def nav_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: the event values of each user in time order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ordered(e, F.col("user_id"), [F.col("ts"), F.col("event_id")], ts=F.col("ts"), nav=F.col("value"))


def nav_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority, as a long daily series."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate")
    total = o.groupBy(F.col("o_orderpriority").alias("p"), day.alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("nav"))
    return ordered(total, F.col("p"), [F.col("day")], day=F.col("day"), nav=F.col("nav"))


def ohlc_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open-high-low-close bar for each event type and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    bars = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close")
    )
    names = ("open", "high", "low", "close")
    return ordered(bars, F.col("event_type"), [F.col("day")], day=F.col("day"), **{n: F.col(n) for n in names})
