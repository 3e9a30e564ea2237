"""Sources: value tables, trades, logs and configuration; readers declare schemas, so no file is scanned to infer one."""

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAV = "Date date, NAV double, PnL double"
TICKS = "agg_trade_id long, price double, quantity double, timestamp long, is_buyer_maker boolean"
LOG = "event string, component string, decision string, test string, payload string"


def read_nav_csv(spark: SparkSession, path: str, pnl: str = "fraction") -> DataFrame:
    """(series_id, seq, day, nav, pnl) of one or many CSV files with a header; the file is the series.

    Columns are found by name. PnL is derived where a file has none. Files without NAV or rows are an error.
    """
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    if "nav" not in names or "date" not in names:
        raise ValueError(f"{path}: Date and NAV are needed, found {raw.columns}")
    given = F.col(names["pnl"]).cast("double") if "pnl" in names else F.lit(None).cast("double")
    rows = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("series_id"), F.col(names["date"]).cast("date").alias("day"), F.col(names["nav"]).try_cast("double").alias("nav"), given.alias("given"))
    order = Window.partitionBy("series_id").orderBy("day")
    before = F.lag("nav").over(order)
    change = F.col("nav") - before
    derived = F.coalesce(change if pnl == "diff" else F.try_divide(change, before), F.lit(0.0))
    out = rows.withColumns({"seq": F.row_number().over(order).cast("long") - 1, "pnl": F.coalesce("given", derived)}).drop("given")
    if out.isEmpty():
        raise ValueError(f"{path}: no rows")
    return out.select("series_id", "seq", "day", "nav", "pnl")


def date_range(spark: SparkSession, path: str, default: tuple[str, str] = ("1970-01-01", "1970-01-01")) -> DataFrame:
    """The first and last date of all files, malformed rows left out."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(NAV).csv(path)
    return rows.agg(F.coalesce(F.min("Date"), F.lit(default[0]).cast("date")).alias("first_day"), F.coalesce(F.max("Date"), F.lit(default[1]).cast("date")).alias("last_day"))


def read_ticks_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(TICKS).csv(path)


def read_values_text(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, seq, nav) of text files with one number a line, in the order of the lines of a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("series_id"), F.monotonically_increasing_id().alias("at"), F.col("value").try_cast("double").alias("nav")).filter("nav is not null")
    return lines.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("at")).cast("long") - 1).alias("seq"), "nav")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pattern, category, reason) of the table rows of markdown files: ``| `pattern` | category | reason |``; ord is
    in the order of the lines of a file, and of files as Spark reads them."""
    rx = r"^\s*\|\s*`([^`]+)`\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|"
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.filter(F.col("value").rlike(rx)).select("ord", *(F.regexp_extract("value", rx, i).alias(n) for i, n in enumerate(("pattern", "category", "reason"), 1)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A long feature table, or a wide one made long; told apart by their columns."""
    from ..operators.features import FeatureStore

    df = spark.read.parquet(path)
    return df if {"feature", "value"} <= set(df.columns) else FeatureStore.from_wide(df).df


def load_config(text: str) -> dict:
    """A TOML configuration, checked: lookbacks and thresholds are positive whole numbers, tolerance is a known preset."""
    config = tomllib.loads(text)
    for key in ("thresholds", "lookbacks"):
        if not config.get(key) or any(not isinstance(x, int) or x <= 0 for x in config[key]):
            raise ValueError(f"{key} must be positive whole numbers")
    if config.get("preset", "strict") not in ("strict", "relaxed", "custom"):
        raise ValueError("unknown preset")
    return config


def last_bars(bars: DataFrame, n: int, end: str, ts: str = "ts") -> DataFrame:
    """The last ``n`` bars of each series up to ``end``, numbered in order."""
    kept = bars.filter(F.col(ts) <= F.lit(end).cast("timestamp")).withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(ts), F.desc("seq"))))
    return kept.filter(F.col("back") <= n).drop("back")


def cache_status(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """(series_id, n_bars, oldest, newest, n_years) of what is stored."""
    return bars.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_bars"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"), F.countDistinct(F.year(ts)).alias("n_years"))


def missing_partitions(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")


def synthetic_nav(spark: SparkSession, series: int, points: int, mean: float = 0.001, std: float = 0.02, seed: int = 42, start: float = 1.0) -> DataFrame:
    """Seeded compounding of normal returns; a value depends on series, position and seed, not on the partitioning."""
    half = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "s", "seq"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    grid = spark.range(series).withColumnRenamed("id", "s").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    normal = F.sqrt(F.lit(-2.0) * F.log(half(1))) * F.cos(F.lit(6.283185307179586) * half(2))
    rets = grid.withColumn("growth", F.greatest(F.lit(1.0 + mean) + F.lit(std) * normal, F.lit(0.01)))
    order = Window.partitionBy("s").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rets.select(F.col("s").cast("string").alias("series_id"), "seq", (F.lit(start) * F.exp(F.sum(F.log("growth")).over(order))).alias("nav"))


def synthetic_regimes(spark: SparkSession, series: int, points: int, mean: float = 0.0005, std: float = 0.008, dof: int = 5, start_share: float = 0.05, length: int = 5, shift: float = -0.01, seed: int = 42) -> DataFrame:
    """Student-t returns with spells of falling (or, by a positive ``shift``, rising) values; bounded and compounded.

    A spell starts at a point with probability ``start_share`` and lasts ``length`` points. All draws are hashes
    of (seed, series, position), so the table does not depend on how it is partitioned.
    """
    half = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "s", "seq"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    normal = lambda salt: F.sqrt(F.lit(-2.0) * F.log(half(salt))) * F.cos(F.lit(6.283185307179586) * half(salt + 1))
    chi = sum((normal(10 + 2 * k) * normal(10 + 2 * k) for k in range(dof)), F.lit(0.0))
    grid = spark.range(series).withColumnRenamed("id", "s").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    drawn = grid.withColumns({"t": normal(1) / F.sqrt(chi / F.lit(float(dof))), "starts": (half(5) < start_share).cast("int")})
    order = Window.partitionBy("s").orderBy("seq")
    spell = F.max("starts").over(order.rowsBetween(-(length - 1), 0))
    growth = F.greatest(F.lit(1.0 + mean) + F.lit(std) * F.col("t") + F.when(spell == 1, F.lit(shift)).otherwise(F.lit(0.0)), F.lit(0.01))
    return drawn.withColumn("growth", growth).select(F.col("s").cast("string").alias("series_id"), "seq", F.exp(F.sum(F.log("growth")).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("nav"))
